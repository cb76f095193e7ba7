import pytest

LONG = "word " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of every awkward kind: nulls anywhere, blanks, one very long text, repeated rows, names that operators use."""
    rows = [
        (1, "The and of it is on the plain of her.", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n\x0b ", "de", "b", 5),
        (5, LONG, "en", "b", len(LONG)), (6, "mail me@example.com or +1 (728) 555-9761 now", "en", None, 3), (6, "mail me@example.com or +1 (728) 555-9761 now", "en", None, 3),
        (7, "Die der und das ist ein haus von der zeit.", "de", "a", 4), (8, "12345 !!! ???", "en", "c", 2), (9, "mail me@example.com or +1 (728) 555-9761 now", "en", "c", 3),
        (None, "The and of it is on the plain of her.", None, "a", 1), (10, "é́ 日本 <|endoftext|> x", "fr", "b", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: c for c in ("id", "size", "target", "taken", "shard", "slot", "score", "kept", "n_shingles", "component_id", "label", "times", "rows", "key", "tag", "n_tokens", "media", "spans", "held_out")}
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(i) for i, c in enumerate(extra)})


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
