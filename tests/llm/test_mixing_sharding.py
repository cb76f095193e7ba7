"""Mixing and sharding against plain loops, and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointloom.llm import mixing, sharding
from pointloom.llm.queries import ORACLE_SQL, QUERIES


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight, left, out = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sizes.values()), {}
    rest = set(names)
    while rest:
        total = sum(weight[s] for s in rest)
        over = {s for s in rest if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in rest}
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
        rest -= over
    return out


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 20, None: 5}, {"a": 0, "b": 0}, {"x": 7}, {"a": 1, "b": 1, "c": 1, "d": 900, "e": 3}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(targets(sizes))


def test_mix(spark, small):
    got = QUERIES["op3_mix_sources"](spark, small).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for rows in by.values():
        near = abs(sum(r.taken for r in rows) - rows[0].target)
        assert near <= max(r.size for r in rows) / 2 and all(r.taken in {k * r.size for k in range(4)} for r in rows)
        epochs = math.floor(rows[0].target / rows[0].source_size)
        assert all(r.taken >= epochs * r.size for r in rows)
    assert sorted(map(tuple, got)) == sorted(map(tuple, QUERIES["op3_mix_sources"](spark, small).collect()))


def test_mix_in_many_ranges(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    once = {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect()}
    monkeypatch.setattr(mixing, "BUCKET", 3)
    many = {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect()}
    assert sum(once[i] != many[i] for i in once) <= 2 * 20


def test_mix_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{small}/documents.parquet'")
    told = con.sql(ORACLE_SQL["op3_mix_sources"])
    ours = QUERIES["op3_mix_sources"](spark, small).select(*told.columns).collect()
    assert sorted(map(tuple, ours)) == sorted(told.fetchall())


def test_mix_of_odd_documents(odd, none):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == 12 and sum(r.taken for r in got if r.doc_id == 2) == 0
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix_sources(none).collect() == [] and mixing.repeat_rows(none).count() == 0
    taken = Counter()
    for r in got:
        taken[r.doc_id] += r.taken
    again = Counter()
    for r in mixing.repeat_rows(odd).collect():
        again[r.doc_id] += len((r.text or "").split(" ")) if r.doc_id != 5 else 30_000
    assert {k: v for k, v in again.items() if k in (1, 7)} == {k: v for k, v in taken.items() if k in (1, 7) and v}
    assert mixing.repeat_rows(odd).columns == odd.columns


def test_shards(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = sharding.shard_by_bytes(docs, 10).collect()
    assert len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r)
    assert set(by) == set(range(10)) and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    sums, most = [sum(r["size"] for r in v) for v in by.values()], max(r["size"] for r in rows)
    assert max(sums) - min(sums) <= 2 * most


def test_a_hot_group_is_split_and_others_stay_together(spark):
    rows = [(i, "hot " * 50) for i in range(4000)] + [(5000 + i, f"text {i // 3} " * 20) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = sharding.shard_by_bytes(df, 20).collect()
    sums, hot, places = Counter(), set(), defaultdict(set)
    text = dict(rows)
    for r in got:
        sums[r.shard] += r["size"]
        places[text[r.doc_id]].add(r.shard)
    hot = places.pop("hot " * 50)
    mean = sum(sums.values()) / 20
    assert max(sums.values()) < 1.03 * mean and min(sums.values()) > 0.97 * mean and len(hot) > 3
    assert all(len(p) == 1 for p in places.values())


def test_shards_of_odd_documents(odd, none):
    got = sharding.shard_by_bytes(odd).collect()
    assert len(got) == 12 and {r["size"] for r in got if r.doc_id in (2, 3)} == {16} and all(0 <= r.shard < 40 for r in got)
    assert sharding.shard_by_bytes(none).collect() == []


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, small)
        seen[name] = (out.columns, out.count())
    assert all(seen[n][0] == docs.columns for n, _ in corpus_pipeline.STAGES[:-1])
    assert docs.count() > seen["quality"][1] > seen["near copies"][1] == seen["personal data"][1]
    assert corpus_pipeline.run(spark, small).count() == seen["mix"][1]


def test_pipeline_stages_on_odd_documents(spark, odd, none):
    for df in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, "").count()
    kept = corpus_pipeline.near_copies(spark, odd, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "2", "3", "4", "5", "6", "7", "8", "10"])
    assert corpus_pipeline.near_copies(spark, odd, "").filter(F.col("doc_id") == 6).count() == 1


def test_repeats_are_those_of_the_mix(spark, monkeypatch):
    """Rows equal in id, source and text but not in other columns are all taken, as often as the mix says."""
    monkeypatch.setattr(mixing, "BUCKET", 4)
    rows = [(i % 7, f"w{i % 7} " * (i % 7), "ab"[i % 7 % 2], i) for i in range(60)] + [(100 + i, "one two three", "c", 100 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    taken, got = Counter(), Counter()
    for r in mixing.mix_sources(df).collect():
        taken[r.doc_id] += r.taken
    for r in mixing.repeat_rows(df).collect():
        got[r.doc_id] += len(r.text.split())
    assert {k: v for k, v in taken.items() if v} == dict(got)
    epochs = Counter(r.other for r in mixing.repeat_rows(df).collect())
    assert all(max(epochs[i] for i in ids) - min(epochs[i] for i in ids) <= 1 for k in range(1, 7) if (ids := range(k, 60, 7)))
