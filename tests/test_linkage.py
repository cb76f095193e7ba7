"""Linkage within one table against brute force: every row is looked at on both sides, only the row itself is no partner."""

import random

import pytest

from pointloom import plans

WORDS = ["red", "hot", "ox", "ring", "bolt", "large ring", "Élan ring", "ring bolt"]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    rng = random.Random(7)
    name = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 2)))
    rows = [(i, name() if i % 17 else None, f"Brand#{rng.randint(1, 3)}", name(), rng.randint(1, 40), float(rng.randint(1, 5)) if i % 13 else None) for i in range(160)]
    d = str(tmp_path_factory.mktemp("parts"))
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{d}/part.parquet")
    return d, rows


def folded(s):
    return None if s is None else s.lower().replace("é", "e")


def key(name, kind):
    return "|".join(sorted(folded(s).split(" ")[-1] for s in (name, kind) if s is not None))


def words(s):
    return {w for w in (folded(s) or "").split(" ") if len(w) >= 3}


def test_two_phase_whole(spark, parts):
    d, rows = parts
    want = {}
    for i, name, _, kind, size, _ in rows:
        others = [r for r in rows if r[0] != i and r[4] == size]
        exact = [r for r in others if key(r[1], r[3]) == key(name, kind)]
        meets = lambda a, b: bool(words(a) & words(b))
        loose = [r for r in others if meets(name, r[1]) and meets(kind, r[3]) or meets(name, r[3]) and meets(kind, r[1])]
        if found := exact or loose:
            best = min(found, key=lambda r: (r[5] is None, -(r[5] or 0), r[0]))
            want[i] = (best[0], 1 if exact else 2)
    got = {r.p_partkey: (r.partner, r.phase) for r in plans.QUERIES["linkage_two_phase_whole"](spark, d).collect()}
    assert got == want
    assert {p for _, p in want.values()} == {1, 2} and any(i % 20 > 6 for i in want) and any(j % 20 > 6 for j, _ in want.values())


def test_unique_whole(spark, parts):
    d, rows = parts
    want = {}
    for i, name, brand, _, size, _ in rows:
        needle = (name or "").split(" ")[0]
        hits = [r[0] for r in rows if r[0] != i and r[2] == brand and r[4] % 5 == size % 5 and needle and needle in (r[1] or "")]
        if len(hits) == 1:
            want[i] = hits[0]
    got = {r.p_partkey: r.partner for r in plans.QUERIES["linkage_unique_whole"](spark, d).collect()}
    assert got == want
    assert any(i % 10 > 5 for i in want) and any(j % 10 > 5 for j in want.values())
