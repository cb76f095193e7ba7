"""Cells of groups hold for any threshold: sets whose sizes are several classes apart still meet."""

import numpy as np
import pytest

from pointloom.llm import jaccard


@pytest.mark.parametrize(("num", "den"), [(50, 100), (30, 100), (60, 100)])
def test_cells_meet_at_low_thresholds(num, den):
    rng = np.random.default_rng(num)
    classes = jaccard.SizeClasses(num, den)
    five = rng.integers(0, 1 << 62, 5).astype(np.uint64)
    looked = 0
    for n in [5] * 20 + rng.integers(1, 120, 200).tolist():
        small = np.unique(np.concatenate([five, rng.integers(0, 1 << 62, n).astype(np.uint64)]))[:n]
        more = rng.integers(0, 1 << 62, int(rng.integers(0, n * (den - num) // num + 1))).astype(np.uint64)
        large = np.unique(np.concatenate([small, more]))
        if den * len(small) >= num * len(large):
            looked += 1
            assert len(np.intersect1d(classes.cells(small), classes.cells(large)))
    assert looked > 150
    a = rng.integers(0, 1 << 62, 9).astype(np.uint64)
    if 5 * den >= num * 9:
        assert len(np.intersect1d(classes.cells(a[:5]), classes.cells(a)))


def test_two_classes_are_enough_at_nine_tenths():
    classes = jaccard.SizeClasses(90, 100)
    classes._reach(5000)
    for n in range(1, 5000):
        k = int(np.searchsorted(classes.low, n, "right")) - 1
        assert k < 2 or 90 * n > 100 * (classes.low[k - 1] - 1)
