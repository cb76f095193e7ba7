"""What near copies leave on disk while they run, and that cells counted in parts give the same."""

import glob
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from pointloom.llm import jaccard
from pointloom.llm.scratch import Scratch, freed_shuffles


def near_copies(n=60):
    rng = random.Random(4)
    base = [[f"w{k}x{i}" for i in range(60)] for k in range(6)]
    texts = []
    for i in range(n):
        own = base[i % 6][:]
        for at in rng.sample(range(60), i % 3):
            own[at] = f"y{i}z{at}"
        texts.append(" ".join(own))
    return list(enumerate(texts))


def shuffle_files(spark):
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in files.split("\n") if "shuffle_" in x}


def test_shuffle_files_go_with_their_query(spark):
    df = spark.createDataFrame(near_copies(), "doc_id long, text string")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(name), shuffle_files(spark)
    jaccard.drop_similar(df)
    assert shuffle_files(spark) <= before
    assert spark.conf.get(name) == setting


def test_setting_comes_back_after_a_fault(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name)
    with pytest.raises(KeyError), freed_shuffles(spark):
        assert spark.conf.get(name) == "true"
        raise KeyError
    assert spark.conf.get(name) == setting


def test_cells_counted_in_parts(spark, monkeypatch):
    """Any number of parts gives the components of brute force, and no table on disk holds the lists of cells at the end."""
    monkeypatch.setattr(jaccard, "PARTS", 3)
    rows, scratch = near_copies(), Scratch(spark)
    out = jaccard.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"), width=5, num=80, den=100, cells="prefix", scratch=scratch)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    least = list(range(len(rows)))
    for _ in rows:
        least = [min(least[j] for j in range(len(rows)) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in range(len(rows))]
    assert [r.component_id for r in out.orderBy("doc_id").collect()] == least
    assert 1 < len(set(least)) < len(rows)
    files = glob.glob(scratch.base.removeprefix("file://") + "/*/*.parquet")
    assert files
    assert not any("keys" in pq.read_schema(x).names for x in files)


@pytest.mark.parametrize("most", [1, 255, 256, 65535, 65536, 1 << 32, 1 << 40])
def test_counters_are_packed_whole(most):
    counts = np.zeros(1 << 14, np.int64)
    counts[[3, 900]] = most, 1
    packed = jaccard._packed(counts)
    assert (jaccard._unpacked(packed) == counts).all()
    assert len(packed) == len(counts) * next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
