from pyspark.sql import functions as F

from pointloom.operators import points as P


def tracks(spark):
    rows = [("m", "near", float(t), 0.5 * t, -12.0, 0) for t in range(12)] + [("m", "far", float(t), -0.5 * t, 12.0, 0) for t in range(12)]
    return spark.createDataFrame(rows, "match string, half string, t double, cx double, cy double, seg int")


def test_enrich(spark):
    contacts = spark.createDataFrame([("m", 1, 2, None, 4.5, "near")], "match string, pid int, shot_no int, serve_no int, t double, hitter_end string")
    r = P.enrich(contacts, tracks(spark)).first()
    assert (r.hx, r.hy, r.ox, r.oy, r.hvx, r.dist_net, r.hit_id) == (2.25, -12.0, -2.25, 12.0, 0.5, 12.0, "1_2_0_4.500")


def test_candidates_serves_and_windows(spark):
    onsets = spark.createDataFrame([("m", 1.0, 9.0, 1), ("m", 5.0, 20.0, 2), ("m", 6.2, 20.0, 3), ("m", 50.0, 9.0, 4)], "match string, t double, z double, oid long")
    segments = spark.createDataFrame([("m", 0.0, 11.0, 7)], "match string, start double, `end` double, seg int")
    cues = spark.createDataFrame([("m", "near", 4.9, 0.8), ("m", "near", 5.2, 0.9)], "match string, half string, t double, arm double")
    rows = P.candidate_features(onsets, segments, tracks(spark), cues, ["arm"])
    got = {r.oid: r for r in rows.collect()}
    assert set(got) == {1, 2, 3} and got[2].n_arm_at == 0.8 and got[2].n_arm_pre == 0.8 and got[2].n_x == 2.5 and abs(got[2].n_spd_before - 0.5) < 1e-9
    labels = spark.createDataFrame([(2, 0.0, 0.9, 0.0, 0.0), (3, 0.0, 0.0, 0.8, 0.0)], "oid long, near_hit double, near_serve double, far_hit double, far_serve double")
    fused = P.fuse(rows, labels)
    assert {r.oid: round(r.hit_n, 2) for r in fused.collect()} == {1: -4.0, 2: 2.2, 3: -4.6}
    serves = P.pick_serves(fused, {"near": 0.5, "far": 0.5})
    assert [(r.t, r.server) for r in serves.collect()] == [(5.0, "near")]
    assert [(r.oid, r.serve_no) for r in P.serve_windows(fused, serves).collect()] == [(3, 1)]


def test_tails_and_labels(spark):
    c = spark.createDataFrame([("m", 1, k, float(k), -11.0, p) for k, p in ((1, 0.9), (2, 0.8), (3, 0.2), (4, 0.9))], "match string, pid int, shot_no int, t double, hy double, p double")
    assert sorted((r.shot_no, r.rally) for r in P.cut_tails(c, "p", 0.5).collect()) == [(1, 2), (2, 2)]
    assert P.tail_features(c).filter("shot_no = 2").first().left == 2
    cand = spark.createDataFrame([("m", 1, i, t, n, f) for i, (t, n, f) in enumerate([(0.9, -2.0, 3.0), (1.5, 0.0, 0.0), (2.0, 3.0, -2.0)])], "match string, pid long, oid long, t double, near double, far double")
    pts = spark.createDataFrame([("m", 1, 0.0, "far", 2)], "match string, pid long, t_serve double, first string, k int")
    assert sorted((r.oid, r.hitter) for r in P.weak_contacts(cand, pts).filter("label = 1").collect()) == [(0, "far"), (2, "near")]


def test_rally_time(spark):
    onsets = spark.createDataFrame([("m", 3.0, 13.0)], "match string, t double, z double")
    points = spark.createDataFrame([("m", 3.0, 5.0)], "match string, t_start double, t_last double")
    got = {r.t: r for r in P.rally_time_features(tracks(spark), onsets, points).collect()}
    assert len(got) == 12 and got[4.0].y and not got[2.0].y and got[3.0].n12_1_0 == 1 and got[4.0].n12_1_0 == 1 and got[2.0].n12_1_0 == 0
    assert got[4.0].since6 == 1.0 and got[3.0].until6 == 0.0 and got[4.0].until6 == 30.0 and got[5.0].near_v3 == 0.5


def test_checks(spark):
    shots = spark.createDataFrame(
        [("m", p, k, "serve" if k == 1 else "rally", "near" if k % 2 else "far", float(p % 3), -12.0 if k % 2 else 11.0, 1.0 + p % 2, 12.0, "4" if p % 2 else "6", "deuce", "volley" if k == 3 else "groundstroke", "", 3.0 if k == 3 else 12.0) for p in range(6) for k in (1, 2, 3)],
        "match string, pid int, shot_no int, kind string, hitter_end string, hx double, hy double, ox double, oy double, direction string, serve_side string, family string, modifiers string, dist_net double",
    )
    r = P.position_checks(shots, ["match"]).first()
    assert r.server_behind == 1.0 and r.auc_net == 1.0 and r.auc_wide in (0.0, 1.0)
    boxes = spark.createDataFrame([("m", 1.0, 0.0, 0.0, 2.0, 2.0)], "match string, t double, x1 double, y1 double, x2 double, y2 double")
    moved = boxes.withColumn("t", F.col("t") + 0.04)
    assert P.compare_boxes(boxes, moved, ["match"]).first().iou == 1.0
