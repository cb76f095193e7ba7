"""What is held from task to task, and members of too few cells."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from pointloom.llm import bpe, jaccard, quality


def test_the_next_stage_lets_go_of_the_encoder():
    from pointloom.llm import worker

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["A few words, and some more."])], ["id", "text"])
    run = bpe._run(public_tokenizers.path("word_bpe_49k.json"), False)
    list(run(iter([batch])))
    first = list(worker._held.values())
    list(run(iter([batch])))
    assert len(first) == 1 and list(worker._held.values())[0] is first[0]
    list(quality._patterns(iter([pa.RecordBatch.from_arrays([pa.array(["words"]), pa.array([True])], ["text", "sampled"])])))
    assert not worker._held


@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100), (1, 2)])
def test_links_share_as_many_cells_as_are_asked_for(num, den):
    rng = np.random.default_rng(num)
    level = np.zeros(1 << 4, np.uint64)
    linked = most = 0
    for _ in range(1500):
        n = int(rng.integers(1, 400))
        common = rng.integers(0, 1 << 62, n).astype(np.uint64)
        extra = rng.integers(0, 1 << 62, int(rng.integers(0, n * (den - num) // den + 2))).astype(np.uint64)
        cut = int(rng.choice([0, len(extra), rng.integers(0, len(extra) + 1)]))
        a, b = np.unique(np.concatenate([common, extra[:cut]])), np.unique(np.concatenate([common, extra[cut:]]))
        if den * len(np.intersect1d(a, b)) < num * len(np.union1d(a, b)):
            continue
        linked += 1
        own, other = (jaccard.prefix_cells(x, num, den, level) for x in (a, b))
        slack = [len(x) // jaccard.STEP for x in (a, b)]
        counted = 0
        for c in np.intersect1d(own, other):
            i, j = int(np.flatnonzero(own == c)[0]), int(np.flatnonzero(other == c)[0])
            counted += len(b) <= jaccard.reach(len(a), max(0, i - slack[0]), num, den) and len(a) <= jaccard.reach(len(b), max(0, j - slack[1]), num, den)
        least = [int(jaccard.least_common(np.int64(len(x)), num, den)) for x in (a, b)]
        assert counted >= max(least)
        most = max(most, *least)
    assert linked > 500 and most > 10


def test_texts_without_a_mark_are_not_shuffled(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(50)] + [(50, " ".join(f"w3x{k}" for k in range(30))), (50, None), (None, "w9 again")]
    df = jaccard.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(df.collect(), key=str) == sorted((r for r in rows if r != rows[50]), key=str)
    assert "Union" in df._jdf.queryExecution().optimizedPlan().toString()
