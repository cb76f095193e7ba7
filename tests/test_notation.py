import random

import pytest
from pyspark.sql import functions as F

from pointloom.operators import notation as N

# Golden strings of the notation.
GOOD = {
    "6*": (1, "ace", "server"),
    "cc4+f1v2*": (3, "winner", "server"),
    "6#": (1, "service_winner", "server"),
    "6f+;28b0f-3d#": (4, "forced_error", "server"),
    "6f2f3w": (3, "other", "returner"),
    "4b29f29C": (3, "other", "server"),
}
FIXED = {"4b72f3*": "4b27f3*", "4f1+v2*": "4f+1v2*", "5bbf@n": "5bbfn@", "4;w": "4w;", "n4": "4n", "4+^f1*": "4^+f1*"}
WRONG = [")*", "3f1w#", "4f12f3*", "4b289f1*", "4f1*f3*", "4f1nf3*", "6n28f1*", "4f2C3*", "4s+f-3d@17D&"]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(s, "") for s in [*GOOD, *WRONG, "S", "R", "P", "Q"]] + [("6n", "5f2n@"), ("4n", "6d"), ("V", "4f29b3d@"), ("4f", "6f1d@"), ("4n", ""), ("S", "4f1*"), (None, None)]
    rows += [(s, "") for s in FIXED if s not in ("4;w", "n4")] + [("4;w", "4f1*"), ("n4", "4f1*")]
    df = N.with_summary(N.parse_points(spark.createDataFrame(rows, "`1st` string, `2nd` string")))
    out = df.withColumn("back", N.serialize(F.col("point"))).collect()
    return {(r["1st"], r["2nd"]): r for r in out}


@pytest.mark.parametrize("s", GOOD)
def test_canonical(parsed, s):
    r = parsed[s, ""]
    assert (r.n_contacts, r.outcome, r.winner_role) == GOOD[s]
    assert r.point.ok and r.point.canonical and r.back.first == s


@pytest.mark.parametrize("s", WRONG)
def test_wrong(parsed, s):
    r = parsed[s, ""]
    assert not r.point.ok and r.n_contacts is None and r.outcome == "other"


def test_two_attempts(parsed):
    r = parsed["6n", "5f2n@"]
    assert (r.in_serve_index, r.n_contacts, r.outcome, r.winner_role) == (2, 2, "unforced_error", "server")
    r = parsed["4n", "6d"]
    assert (r.in_serve_index, r.n_contacts, r.outcome, r.winner_role) == (None, 0, "double_fault", "returner")
    r = parsed["V", "4f29b3d@"]
    assert (r.in_serve_index, r.n_contacts, r.winner_role) == (2, 3, "returner")
    for bad in (("4f", "6f1d@"), ("4n", ""), ("S", "4f1*"), (None, None)):
        assert not parsed[bad].point.ok


def test_codes(parsed):
    assert [parsed[c, ""].winner_role for c in "SRPQ"] == ["server", "returner", "returner", "server"]
    assert all(parsed[c, ""].n_contacts is None for c in "SRPQ")


def test_put_right(parsed):
    for s, want in FIXED.items():
        r = parsed[s, ""] if (s, "") in parsed else parsed[s, "4f1*"]
        assert r.back.first == want and not r.point.canonical, s


def test_contacts(spark):
    rows = [(1, 1, "6n", "5f2n@"), (2, 2, "V", "4f1*"), (3, None, "4f1*", ""), (4, 1, "S", ""), (5, 1, "4n", "4n")]
    pts = N.parse_points(spark.createDataFrame(rows, "Pt int, Svr int, `1st` string, `2nd` string"))
    got = sorted((r.Pt, r.shot_no, r.hitter) for r in N.contacts(pts, ["Pt"]).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1), (5, 0, 1), (5, 0, 1)]


def test_round_trip_of_random_points():
    rng = random.Random(3)
    for _ in range(2000):
        shots = "".join(rng.choice(N.LETTERS) + rng.choice(["", "+", "-", "="]) + rng.choice(["", "1", "2", "3", "0"]) + rng.choice(["", "7", "8", "9"]) for _ in range(rng.randint(1, 8)))
        s = "c" * rng.randint(0, 2) + rng.choice("4560") + rng.choice(["", "+", "^"]) + shots + rng.choice(["", "n", "dx"]) + rng.choice(["*", "#", "@"])
        p = N.parse_attempt(s)
        assert not p["errors"] and p["canonical"], s
        assert "".join("".join(x for x in shot.values() if x) for shot in p["shots"]) == s[len(s) - len("".join("".join(x for x in shot.values() if x) for shot in p["shots"])) :]
