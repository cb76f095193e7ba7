import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom import schema, session
from pointloom.functions import columns as C
from pointloom.functions import geometry as G
from pointloom.operators import analytics as A
from pointloom.operators import metrics as M
from pointloom.operators import relational as R
from pointloom.operators import temporal as T
from pointloom.sources import files
from pointloom.streaming import jobs


def test_text(spark):
    df = spark.createDataFrame([("Björn Borg-Łęç",), ("  ",), (None,)], "s string")
    assert [r[0] for r in df.select(C.fold_name(F.col("s"))).collect()] == ["bjorn borg ec", "", None]
    pts = spark.createDataFrame([("40-AD", False), ("AD-15", False), ("12-10", True), ("x", False)], "p string, t boolean")
    assert [r[0] and tuple(r[0]) for r in pts.select(C.parse_pts(F.col("p"), F.col("t"))).collect()] == [(3, 4), None, (12, 10), None]
    assert spark.range(1).select(C.fault_type(F.lit("!n")), C.fault_type(F.lit("wd")), C.fault_type(F.lit("!"))).first() == ("net", "wide_and_deep", "shank")


def test_geometry(spark):
    row = spark.range(1).select(
        G.serve_side(F.lit(1.0), F.lit(True)), G.serve_side(F.lit(-1.0), F.lit(False)),
        G.box_iou(*[F.lit(float(v)) for v in (0, 0, 2, 2, 1, 1, 3, 3)]),
        G.project(G.inverse(F.array(*[F.lit(float(v)) for v in (2, 0, 1, 0, 3, 2, 0, 0, 1)])), F.lit(5.0), F.lit(8.0)),
    ).first()
    assert row[0] == "deuce" and row[1] == "deuce" and row[2] == pytest.approx(1 / 7)
    assert tuple(row[3]) == pytest.approx((2.0, 2.0))


def test_asof_buckets_agree(spark):
    rng = np.random.default_rng(5)
    left = spark.createDataFrame([(int(k), float(t)) for k, t in zip(rng.integers(0, 3, 200), rng.integers(0, 500, 200))], "k int, t double")
    right = spark.createDataFrame([(int(k), float(t), i, None if i % 9 == 0 else i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 500, 60)))], "k int, t double, i int, v int")
    for forward in (False, True):
        for strict in (False, True):
            plain, cut = (sorted(map(str, T.asof(left, right, ["k"], "t", ["i", "v"], order="i", forward=forward, strict=strict, bucket=b).collect())) for b in (None, 50.0))
            assert plain == cut
            data = right.collect()
            for r in T.asof(left, right, ["k"], "t", ["i"], order="i", forward=forward, strict=strict).collect():
                ok = [x for x in data if x.k == r.k and ((x.t > r.t if strict else x.t >= r.t) if forward else (x.t < r.t if strict else x.t <= r.t))]
                want = (min if forward else max)(ok, key=lambda x: (x.t, x.i)).i if ok else None
                assert r.r_i == want


def test_segments(spark):
    df = spark.createDataFrame([("a", float(t)) for t in (0, 1, 2, 3, 10, 11, 20, 21, 22, 23)], "m string, t double")
    assert sorted((r.start, r.end) for r in T.segments(df, ["m"], "t").collect()) == [(-0.5, 3.5), (19.5, 23.5)]


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.2), (0, 0.7), (0, 0.1), (1, 0.8)], "y int, p double")
    r = M.binary_score(df, [], F.col("p"), F.col("y")).first()
    assert (r.precision, r.recall, r.accuracy) == pytest.approx((2 / 3, 2 / 3, 0.6))
    assert M.auc(df, [], "p", F.col("y") == 1).first().auc == pytest.approx(5 / 6)
    assert M.auc(df.filter("y = 1"), [], "p", F.col("y") == 1).first().auc is None


def test_grid(spark):
    df = spark.createDataFrame([(2.1, -11.985)], "x double, y double")
    r = A.histogram2d(df, [], F.col("x"), F.col("y"), (-8.0, 8.0), (-20.0, 0.0), 0.5).first()
    assert (r.row, r.col, r.n) == (23, 20, 1)
    blur = A.blurred(A.histogram2d(df, [], F.col("x"), F.col("y"), (-8.0, 8.0), (-20.0, 0.0), 0.5), [], 0.45, 0.5, (40, 32))
    assert blur.agg(F.sum("n")).first()[0] == pytest.approx(1.0)


def test_win_map(spark):
    rows = [(-0.75, 0.0, 1 if i < 30 else 0) for i in range(50)] + [(2.25, -1.5, 1 if i < 10 else 0) for i in range(50)]
    got = {(r.x, r.depth): r.won for r in A.win_map(spark.createDataFrame(rows, "x double, d double, w int"), F.col("x"), F.col("d"), F.col("w")).collect()}
    assert sorted(got.values()) == [0.2, 0.6]


def test_whole_copies(spark):
    rows = [("m", 1, "4f1*", 0), ("m", 2, "S", 1), ("m", 1, "4f", 2), ("m", 2, "4f2n@", 3), ("n", 1, "6*", 4), ("n", 1, "6*", 5)]
    df = spark.createDataFrame(rows, "match string, pt int, s string, line int")
    kept, gone = R.whole_copies(df, "match", "pt", "line", (F.col("s") == "S").cast("int"), F.length("s"))
    assert sorted((r.match, r.pt, r.s) for r in kept.collect()) == [("m", 1, "4f"), ("m", 2, "4f2n@"), ("n", 1, "6*")]
    assert {r.match: r.dropped for r in gone.collect()} == {"m": 2, "n": 1}


def test_sources(spark, tmp_path):
    path = tmp_path / "charting-m-points-2020s.csv"
    path.write_bytes("match_id,Pt,Set1,Set2,Gm1,Gm2,Pts,Gm#,TbSet,Svr,1st,2nd,Notes,PtWinner\nMüller,1 ,0,0,0,0,0-0,1,True,1, 4f1* ,,x,1\nMüller,2,0,0,0,0,15-0,1,?,1,6*,,,q\n".encode("latin-1"))
    rows, gone = files.read_points(spark, [str(path)])
    got = sorted(rows.collect(), key=lambda r: r.Pt)
    assert [(r.match_id, r.Pt, r["1st"], r.TbSet, r.PtWinner) for r in got] == [("Müller", 1, "4f1*", True, 1), ("Müller", 2, "6*", None, None)]
    assert gone.first().dropped == 0
    df = spark.createDataFrame([("a", 1), ("b", 2)], "video_id string, x int")
    files.write_stage(df, str(tmp_path / "out"), "shots")
    files.write_stage(df.filter("x = 1").withColumn("x", F.lit(7)), str(tmp_path / "out"), "shots")
    assert sorted((r.video_id, r.x) for r in files.read_stage(spark, str(tmp_path / "out"), "shots", "video_id", "x").collect()) == [("a", 7), ("b", 2)]
    assert files.markdown(df.orderBy("x")).splitlines()[2] == "| a | 1 |"


def test_ledger_tail(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = {"t": 1.0, "key": "k", "input_tokens": 5, "usd": 0.5, "label": "onset:1"}
    (tmp_path / "in/1.json").write_text(json.dumps(line) + "\n")
    totals = lambda: jobs.running_totals(jobs.tail(spark, str(tmp_path / "in"), schema.LEDGER), [F.col("label")], ["input_tokens"])
    assert jobs.drain(totals(), "ledger", str(tmp_path / "cp"), "complete").first().input_tokens == 5
    (tmp_path / "in/2.json").write_text(json.dumps(line) + "\n")
    assert jobs.drain(totals(), "ledger", str(tmp_path / "cp"), "complete").first().input_tokens == 10


def test_folder_of_a_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    assert session.work_folder(spark).startswith(base or "file:")
