import random

from pyspark.sql import functions as F

from pointloom.operators import scoring as S


def run(winners, first=1, match=None):
    return list(S.replay_rows(match or S.Match(), first, iter(winners)))


def test_deuce():
    rows = run([1, 1, 1, 2, 2, 2, 1, 2, 2])
    assert [r["pts"] for r in rows] == ["0-0", "15-0", "30-0", "40-0", "40-15", "40-30", "40-40", "AD-40", "40-40"]
    assert [r["side"] for r in rows] == ["deuce", "ad"] * 4 + ["deuce"]


def test_tiebreak_servers_and_ends():
    m = S.Match()
    s = m.resume((0, 0), (6, 6), (0, 0), 1)
    servers, swapped = [], []
    for k in range(18):
        servers.append(m.server(s))
        swapped.append(s.swapped)
        s = m.after(s, 1 + k % 2)
    assert servers[:12] == [1, 2, 2, 1, 1, 2, 2, 1, 1, 2, 2, 1]
    assert swapped == [0] * 6 + [1] * 6 + [0] * 6


def test_ends_after_holds():
    rows = run([w for g in range(5) for w in [1 + g % 2] * 4])
    assert [rows[4 * g]["ends_swapped_before_point"] for g in range(5)] == [0, 1, 1, 0, 0]


def test_match_end():
    rows = run([1] * 49, first=2)
    assert rows[47]["set_score"] == "1-0" and not rows[47]["after_match_end"]
    assert rows[48]["after_match_end"] and rows[48]["set_score"] == "2-0"


def test_missing_winner_stops():
    rows = run([1, None, 1])
    assert [r["after_match_end"] for r in rows] == [False, False, True]


def test_rules(spark):
    rows = [("US Open", 2001), ("US Open", 2022), ("Australian Open", 2018), ("AO", 2019), ("us_open", 1972)]
    df = spark.createDataFrame(rows, "t string, y int").select(S.rule_name(F.col("t"), F.col("y"), True).alias("r"))
    assert [r.r for r in df.collect()] == ["seven", "ten", "long", "ten", "sudden"]


def test_steps_agree_with_replay(spark):
    rng = random.Random(1)
    rows = [(m, k, rng.choice([1, 2, 1]), 1 + m % 2, 3, "seven", "ten") for m in range(12) for k in range(1, 260)]
    df = spark.createDataFrame(rows, "match int, pt int, winner int, first_server int, best_of int, regular_rule string, final_rule string")
    replayed = S.replay(df, "match", "pt", "winner")
    assert replayed.count() == len(rows)
    steps = S.check_steps(replayed.filter("not after_match_end").join(df, ["match", "pt"]), "match", "pt", "winner")
    assert steps.filter("not step_ok").count() == 0 and steps.filter("step_ok").count() > 500
    out = S.validate(replayed, replayed, "match", "pt", S.check_steps(replayed.join(df, ["match", "pt"]), "match", "pt", "winner"))
    assert {r.category for r in out.collect()} == {"clean"}
