"""Near-duplicate vectors that share a direction, in one label of many windows: isolated pairs are found all the same."""

import numpy as np

from pointloom.llm import neardup


def pairs(n, dim, shared, seed, cosine=0.9801):
    """n unit vectors, unrelated ones at a mean cosine of ``shared``; each even row and the next are a pair at ``cosine``."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    z = unit(rng.standard_normal((n // 2, dim)))
    z[:, 0] = 0
    a = np.sqrt(1 - shared) * unit(z)
    a[:, 0] = np.sqrt(shared)
    other = rng.standard_normal((n // 2, dim))
    other = unit(other - (other * a).sum(axis=1, keepdims=True) * a)
    return np.stack([a, cosine * a + np.sqrt(1 - cosine * cosine) * other], axis=1).reshape(n, dim)


def test_passes_grow():
    assert neardup.passes_for(700, 0.0, 0.98, 128, 8) == neardup.passes_for(100, 0.9, 0.98, 128, 8) == 8
    few, many = (neardup.passes_for(n, 0.8, 0.98, 128, 8) for n in (200_000, 1_000_000))
    assert 8 < few < many
    assert neardup.passes_for(1000, 0.999, 0.98, 16, 8) == 63


def test_pairs_about_a_common_direction(spark):
    x = pairs(6000, 32, 0.8, 1)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = np.zeros(len(x), np.int64)
    for r in neardup.near_duplicates(df, window=8, block=16).collect():
        got[r.vec_id] = r.n_links
    c = x @ x.T >= 0.98
    np.fill_diagonal(c, False)
    assert (got <= c.sum(axis=1)).all() and got.sum() >= 0.98 * c.sum() >= 5000
