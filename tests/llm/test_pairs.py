"""The join of near copies and the near-duplicate vectors against brute force."""

import random

import numpy as np
import pytest

from pointloom.llm import jaccard, neardup, shingles
from pointloom.llm.components import connected_components
from pointloom.llm.scratch import Scratch


def roots(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def words(text):
    return (text or "").encode().lower().split()


def brute(texts, width, num, den):
    sets = [{tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if (w := words(t)) else set() for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    return [len(s) for s in sets], roots(len(sets), links)


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ä", "the", "The"]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.6:
            own = rng.choice(out).split()
            for _ in range(rng.randint(0, 4)):
                if own:
                    at = rng.randrange(len(own))
                    own[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
            out.append(" ".join(own))
        elif kind < 0.8:
            out.append(" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]))
        else:
            out.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120))))
    return out


@pytest.mark.parametrize(("cells", "width", "num", "den"), [("groups", 3, 90, 100), ("prefix", 5, 80, 100), ("groups", 2, 70, 100), ("prefix", 3, 90, 100)])
def test_same_as_brute_force(spark, cells, width, num, den):
    texts = corpus(width * num)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard.similar_sets(df, width=width, num=num, den=den, cells=cells).collect()}
    sizes, least = brute(texts, width, num, den)
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == least
    assert len(set(least)) < len(least) - 20


@pytest.mark.parametrize("cells", ["groups", "prefix"])
def test_odd_documents(odd, none, cells):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_sets(odd, cells=cells).collect()), key=str)
    assert len(got) == 12
    at = {g[0]: g for g in got}
    assert at[2][1:] == (0, 2) and at[3][1:] == (0, 3) and at[4][1:] == (0, 4) and at[5][1:] == (1, 5)
    assert at[9][2] == at[6][2] == 6 and at[None][2] == 1 == at[1][2]
    assert jaccard.similar_sets(none, cells=cells).collect() == []


def test_cells_meet_for_every_link():
    rng = np.random.default_rng(4)
    classes = jaccard.SizeClasses(9, 10)
    for _ in range(1500):
        n = int(rng.integers(1, 400))
        common = rng.integers(0, 1 << 62, n).astype(np.uint64)
        extra = rng.integers(0, 1 << 62, int(rng.integers(0, max(1, n // 8) + 1))).astype(np.uint64)
        cut = int(rng.integers(0, len(extra) + 1))
        a, b = np.unique(np.concatenate([common, extra[:cut]])), np.unique(np.concatenate([common, extra[cut:]]))
        if 10 * len(np.intersect1d(a, b)) >= 9 * len(np.union1d(a, b)):
            assert len(np.intersect1d(classes.cells(a), classes.cells(b)))


@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100), (1, 2)])
def test_first_common_shingle_is_in_reach(num, den):
    rng = np.random.default_rng(num)
    level = np.zeros(1 << 4, np.uint64)
    linked = 0
    for _ in range(1500):
        n = int(rng.integers(1, 200))
        common = rng.integers(0, 1 << 62, n).astype(np.uint64)
        extra = rng.integers(0, 1 << 62, int(rng.integers(0, n * (den - num) // den + 2))).astype(np.uint64)
        cut = int(rng.integers(0, len(extra) + 1))
        a, b = np.unique(np.concatenate([common, extra[:cut]])), np.unique(np.concatenate([common, extra[cut:]]))
        if den * len(np.intersect1d(a, b)) < num * len(np.union1d(a, b)):
            continue
        linked += 1
        own, other = (jaccard.prefix_cells(x, num, den, level) for x in (a, b))
        first = np.intersect1d(own, other)[0]
        i, j = int(np.flatnonzero(own == first)[0]), int(np.flatnonzero(other == first)[0])
        assert len(b) <= jaccard.reach(len(a), i, num, den) and len(a) <= jaccard.reach(len(b), j, num, den)
    assert linked > 500


@pytest.mark.parametrize(("cells", "width", "num", "den"), [("groups", 3, 90, 100), ("prefix", 5, 80, 100)])
def test_large_cells_like_small_ones(spark, monkeypatch, cells, width, num, den):
    monkeypatch.setattr(jaccard, "SMALL", 1)
    texts = corpus(width * num)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similar_sets(df, width=width, num=num, den=den, cells=cells).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, width, num, den)[1]


def test_tree_finds_all_within_the_bound():
    rng = np.random.default_rng(1)
    counts = rng.poisson(4, (500, 16))
    counts[100:140] = counts[0] + rng.integers(0, 2, (40, 16))
    points = np.concatenate([counts.sum(axis=1, keepdims=True), counts], axis=1)
    tree = jaccard.RTree(points)
    for q in points[:150]:
        want = {i for i, p in enumerate(points) if np.minimum(q[1:], p[1:]).sum() * 19 >= 9 * (q[0] + p[0])}
        assert set(tree.search(q, 9, 10).tolist()) == want


def test_words_by_bytes_and_by_split():
    import pyarrow as pa

    texts = ["a b", None, "", "\x1cA\x85b \t c\x0b\x0cd", "É é\n", " x", "y ", "Zed"]
    _, at = shingles.word_hashes(*shingles.utf8(pa.array(texts)))
    assert (at[1:] - at[:-1]).tolist() == [len(words(t)) for t in texts]
    one = shingles.shingle_sets(pa.array(["The END x"] * 2 + ["the end x"]).slice(1), 5)
    assert (one[0] == one[1]).all()


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long"), Scratch(spark)).collect()}
    want = roots(300, links)
    assert all(got[n] == want[n] for n in got) and {a for p in links for a in p if p[0] != p[1]} <= set(got)
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).collect() == []


def vectors(seed, n=700, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((60, dim))
    return [(centres[rng.integers(0, 60)] + rng.standard_normal(dim) * rng.choice([0.02, 0.12, 0.8])).astype(np.float32).tolist() for _ in range(n)]


def test_vectors_against_brute_force(spark):
    rows = [(i, v, i % 3 if i % 11 else None) for i, v in enumerate(vectors(3))]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in neardup.near_duplicates(df, window=16, block=64).collect()}
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([-1 if r[2] is None else r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label) & (label >= 0)
    np.fill_diagonal(near, False)
    least = roots(len(rows), zip(*np.nonzero(near)))
    ids = [r[0] for r in rows]
    same = sum(got[i].component_id == ids[least[k]] for k, i in enumerate(ids))
    found, there = sum(got[i].n_links for i in ids), int(near.sum())
    assert there > 1000 and found <= there and found >= 0.99 * there and same >= 0.98 * len(ids)
    assert all(got[i].n_links <= near[k].sum() and got[i].kept == (got[i].component_id == i) for k, i in enumerate(ids))


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, v, None), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 3.0], 1), (7, [float("nan"), 1.0, 1.0], 1), (8, [1.0, 2.0], 1), (9, [], 1), (10, [2.0, 4.0, 6.0], 1), (2, v, 1), (11, v, 2), (12, [float("inf")] * 3, 1), (13, [1e-30, 2e-30, 3e-30], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as rep", "2 as name", "3 as unit", "4 as n")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11, 12)]
    assert got == sorted([(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (10, 4, 1, False), (13, 4, 1, False), *alone])
    assert neardup.near_duplicates(df.filter("false")).collect() == []


def test_points_bound_the_overlap_at_every_size():
    rng = np.random.default_rng(9)
    for n in (5, 400, 600, 1500, 9000):
        base = rng.integers(0, 1 << 62, n).astype(np.uint64)
        a = np.unique(base)
        near = np.unique(np.concatenate([base[: int(n * 0.95)], rng.integers(0, 1 << 62, n // 20).astype(np.uint64)]))
        far = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        points = [np.concatenate([[len(s)], jaccard.count_vector(s)]).astype(np.int32) for s in (a, near, far)]
        assert all(p[1:].sum() == p[0] for p in points)
        groups = min(map(len, points)) - 1
        folded = [jaccard.fold(p[1:], groups) for p in points]
        assert np.minimum(folded[0], folded[1]).sum() >= len(np.intersect1d(a, near))
        assert jaccard.may_link(points[0], points[1], 80, 100) or n < 20
        assert not jaccard.may_link(points[0], points[2], 80, 100)


def test_copies_go_by_id_and_text(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(3, a), (5, a), (5, b), (None, a + " more"), (None, c), (7, c), (7, c), (8, ""), (8, None), (9, c + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as sig", "3 as class", "4 as n", "5 as __stays")
    got = jaccard.drop_similar(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, a), (5, b), (7, c), (8, ""), (8, None)], key=str)
    assert jaccard.drop_similar(df.filter("false")).collect() == []


def test_groups_without_a_centre(spark, monkeypatch):
    """Near copies of which few are near enough to any one of them: several components, blocks and guests in each cell."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "ROOM", 2048)
    monkeypatch.setattr(jaccard, "ASKS", 8)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for i in range(150):
        own = base[:]
        for at in rng.sample(range(90), rng.choice([1, 2, 3, 4])):
            own[at] = f"x{i}y{at}"
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similar_sets(df, width=5, num=80, den=100, cells="prefix").collect()}
    least = brute(texts, 5, 80, 100)[1]
    assert [got[i] for i in range(len(texts))] == least
    assert 3 < len(set(least)) < 120


def test_repeated_ids_with_unlike_vectors(spark):
    """Links and components go by vectors, whatever ids they have."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    rows = []
    for k in range(400):
        i = int(rng.integers(0, 40))
        v = base[i] + rng.standard_normal(16) * float(rng.choice([0.0, 0.02, 0.1]))
        rows.append((int(rng.integers(0, 60)) if k % 9 else None, v.tolist(), int(i % 3)))
    rows += [(1, [1.0, 0.0], 7), (1, [1.0, 0.01], 7), (1, [0.0, 1.0], 7), (2, [1.0, 0.02], 7), (3, [0.01, 1.0], 7), (4, [1.0, 0.0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    linked = [[False] * len(rows) for _ in rows]
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                linked[a][b] = linked[b][a] = True
    root = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if linked[a][b]])
    want = []
    for a in range(len(rows)):
        ids = [rows[b][0] for b in range(len(rows)) if root[b] == root[a] and rows[b][0] is not None]
        least = min(ids, default=None)
        want.append((rows[a][0], sum(linked[a]), least, rows[a][0] == least))
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
