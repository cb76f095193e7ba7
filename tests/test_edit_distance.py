"""Distances of adjacent words against brute force: the end of a long text counts as its beginning does."""

import random
import re

from pointloom import plans


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_words_of_the_whole_text(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé日") for _ in range(rng.randint(1, 9)))
    long = " ".join(word() for _ in range(400))
    texts = [long, long + " zzzzzzzzzzzz", "", None, " \t\n ", "one", " a\u00a0b  bc\nabc ", "same same", *[" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(30)]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.pairs, r.distance, r.furthest) for r in plans.QUERIES["edit_distance_words"](spark, str(tmp_path)).collect()}
    want = {}
    for i, t in enumerate(texts):
        if t is not None:
            w = [x for x in re.split(r"\s+", t, flags=re.ASCII) if x]
            each = [distance(a, b) for a, b in zip(w, w[1:])]
            want[i] = (len(each), sum(each), max(each, default=None))
    assert got == want
    assert got[0] != got[1]
