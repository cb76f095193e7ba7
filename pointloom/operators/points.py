"""Candidates, contacts and points of a match: features, evidence, identity, labels, and the checks made on them.

Tables are keyed by ``match``; times are seconds as doubles.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import geometry as G
from . import metrics as M
from . import sequence as Q
from . import temporal as T

ENDS = ("near", "far")


def candidate_features(onsets: DataFrame, segments: DataFrame, tracks: DataFrame, cues: DataFrame, cue_names: list[str]) -> DataFrame:
    """Onsets inside a segment, with both players' places, their speeds before and after, and the largest cues around.

    ``tracks``: match, half, t, cx, cy; ``cues``: match, half, t and the names. Windows: [t - 0.55, t + 0.10] before, 0.15 both
    sides at the onset.
    """
    rows = T.in_interval(onsets, segments, ["match"], "t", "start", "end", ["seg"]).filter("seg is not null")
    w = Window.partitionBy("match", "seg").orderBy("t")
    rows = rows.withColumn("dt_prev", F.col("t") - F.lag("t").over(w)).withColumn("dt_next", F.lead("t").over(w) - F.col("t"))
    for half in ENDS:
        h, own = half[0], tracks.filter(F.col("half") == half).select("match", "t", "cx", "cy")
        for name, shift in (("", 0.0), ("_before", -1.0), ("_after", 0.6)):
            moved = rows.withColumn("_now", F.col("t")).withColumn("t", F.col("t") + shift)
            rows = T.lerp(moved, own, ["match"], "t", ["cx", "cy"], tolerance=0.5, prefix=f"at_{h}{name}_").withColumn("t", F.col("_now")).drop("_now")
        x, y = f"at_{h}_cx", f"at_{h}_cy"
        speed = lambda name, dt: F.hypot(F.col(f"at_{h}{name}_cx") - F.col(x), F.col(f"at_{h}{name}_cy") - F.col(y)) / dt  # noqa: B023, E731
        rows = rows.withColumn(f"{h}_spd_before", speed("_before", 1.0)).withColumn(f"{h}_spd_after", speed("_after", 0.6))
        rows = rows.withColumn(f"{h}_x", F.col(x)).withColumn(f"{h}_y", F.col(y)).drop(*[c for c in rows.columns if c.startswith(f"at_{h}")])
        samples = cues.filter(F.col("half") == half).select("match", "t", *[F.col(c).alias(f"_{c}") for c in cue_names], F.lit(True).alias("_cue"))
        both = rows.unionByName(samples, allowMissingColumns=True)
        at, (before, after, near) = T.ticks("t", 0.55, 0.10, 0.15)
        by = Window.partitionBy("match").orderBy(at)
        for c in cue_names:
            both = both.withColumn(f"{h}_{c}_pre", F.max(f"_{c}").over(by.rangeBetween(-before, after))).withColumn(f"{h}_{c}_at", F.max(f"_{c}").over(by.rangeBetween(-near, near)))
        rows = both.filter("_cue is null").drop("_cue", *[f"_{c}" for c in cue_names])
    return rows


def fuse(candidates: DataFrame, labels: DataFrame, z0: float = 20.0, audio: float = 0.0, bias: float = 0.0, unlabelled: float = -4.0) -> DataFrame:
    """Evidence for a contact by each end, hit_n and hit_f, from labels' probabilities (keyed by oid) and loudness."""
    rows = candidates.join(labels, "oid", "left")

    def score(end: str) -> Column:
        p = F.col(f"{end}_hit") + F.col(f"{end}_serve")
        return F.coalesce(C.logit(p) + C.loudness(F.col("z"), audio, z0) + bias, F.lit(unlabelled))

    return rows.withColumn("hit_n", score("near")).withColumn("hit_f", score("far"))


def pick_serves(candidates: DataFrame, thresholds: dict[str, float], quiet: float = 2.5, apart: float = 2.0) -> DataFrame:
    """Serves from probabilities: in place, after a quiet spell, the likeliest first, none within ``apart`` of another."""
    hit = F.greatest(F.coalesce("near_hit", F.lit(0.0)), F.coalesce("far_hit", F.lit(0.0)))
    rows = T.quiet_before(candidates, ["match", "seg"], "t", hit >= 0.5, quiet, 0.3)
    found = None
    for end, own, other in (("near", "n", "f"), ("far", "f", "n")):
        p = F.coalesce(F.col(f"{end}_serve"), F.lit(0.0))
        ok = (p >= thresholds[end]) & (F.abs(f"{own}_y") >= 10) & (F.abs(f"{own}_x") <= 5) & (F.abs(F.coalesce(F.col(f"{other}_y"), F.lit(12.0))) >= 6) & F.col("quiet")
        part = rows.filter(ok).select("match", "seg", "t", "z", F.lit(end).alias("server"), p.alias("p"), F.col(f"{own}_x").alias("sx"), F.col(f"{own}_y").alias("sy"))
        found = part if found is None else found.unionByName(part)
    return Q.suppress_groups(found, ["match"], "t", "p", "server", apart)


def serve_windows(candidates: DataFrame, serves: DataFrame) -> DataFrame:
    """Each candidate with the serve it may answer: the last before it, at least 0.05 s back, the next 0.5 s off at least."""
    w = Window.partitionBy("match").orderBy("t")
    own = serves.withColumn("t_serve", F.col("t")).withColumn("until", F.lead("t").over(w) - 0.5).withColumn("serve_no", F.row_number().over(w))
    hit = T.asof(candidates, own, ["match"], "t", ["t_serve", "until", "serve_no", "server", "seg"], order="serve_no", prefix="_s_")
    inside = (F.col("seg") == F.col("_s_seg")) & (F.col("t") > F.col("_s_t_serve") + 0.05) & (F.col("_s_until").isNull() | (F.col("t") < F.col("_s_until")))
    return hit.filter(inside).select(*candidates.columns, F.col("_s_serve_no").alias("serve_no"), F.col("_s_t_serve").alias("t_serve"), F.col("_s_server").alias("server"))


def enrich(contacts: DataFrame, tracks: DataFrame) -> DataFrame:
    """Contacts with the hitter's and the other player's place, the hitter's velocity and distance from the net, and an identity."""
    rows = contacts.withColumn("half", F.col("hitter_end"))
    out = T.lerp(rows, tracks, ["match", "half"], "t", ["cx", "cy"], tolerance=0.5, prefix="h")
    back = T.asof(out, tracks, ["match", "half"], "t", ["cx", "cy"], prefix="_b_")
    both = T.asof(back, tracks, ["match", "half"], "t", ["cx", "cy"], forward=True, strict=True, prefix="_f_")
    dt = F.col("_f_t") - F.col("_b_t")
    both = both.withColumn("hvx", F.when(dt > 0, (F.col("_f_cx") - F.col("_b_cx")) / dt)).withColumn("hvy", F.when(dt > 0, (F.col("_f_cy") - F.col("_b_cy")) / dt))
    other = both.drop(*[c for c in both.columns if c[:3] in ("_b_", "_f_")]).withColumn("half", F.when(F.col("hitter_end") == "near", "far").otherwise("near"))
    other = T.lerp(other, tracks, ["match", "half"], "t", ["cx", "cy"], tolerance=0.5, prefix="o")
    identity = F.concat_ws("_", "pid", "shot_no", F.coalesce("serve_no", F.lit(0)), F.format_string("%.3f", "t"))
    named = other.withColumnsRenamed({"hcx": "hx", "hcy": "hy", "ocx": "ox", "ocy": "oy"})
    return named.withColumn("dist_net", F.abs("hy")).withColumn("hit_id", identity).drop("half")


def attach_truth(contacts: DataFrame, aligned: DataFrame, charted: DataFrame) -> DataFrame:
    """Contacts with the charted point of theirs and its shot of the same number; and whether both count as many contacts."""
    rows = contacts.join(aligned.select("match", "pid", "pt"), ["match", "pid"], "left")
    told = charted.select("match", F.col("Pt").alias("pt"), "shot_no", "letter", "side", "family", "hitter")
    counts = charted.groupBy("match", F.col("Pt").alias("pt")).agg(F.max("shot_no").alias("_told"))
    ours = F.max("shot_no").over(Window.partitionBy("match", "pid"))
    rows = rows.withColumn("_ours", ours).join(told, ["match", "pt", "shot_no"], "left").join(counts, ["match", "pt"], "left")
    return rows.withColumn("point_count_exact", F.col("_ours") == F.col("_told")).drop("_ours", "_told")


def weak_contacts(candidates: DataFrame, points: DataFrame) -> DataFrame:
    """Labels for a contact model: in points charted with k contacts after the serve, the best k candidates are contacts.

    ``candidates`` hold match, pid, oid, t, near, far; ``points`` match, pid, t_serve, first, k. A row comes back for each
    candidate and hitter.
    """
    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        top = pdf.iloc[0]
        path = Q.exactly(pdf.t.to_numpy(), pdf.near.to_numpy(), pdf.far.to_numpy(), float(top.t_serve), top["first"], int(top.k))
        if path is None:
            return pd.DataFrame(columns=["match", "pid", "oid", "hitter", "label"])
        turn = {i: j for j, i in enumerate(path)}
        ends = (top["first"], "far" if top["first"] == "near" else "near")
        rows = [(top.match, top.pid, o, end, int(i in turn and ends[turn[i] % 2] == end)) for i, o in enumerate(pdf.oid) for end in ENDS]
        return pd.DataFrame(rows, columns=["match", "pid", "oid", "hitter", "label"])

    kind = candidates.schema["match"].dataType.simpleString()
    return candidates.join(points, ["match", "pid"]).groupBy("match", "pid").applyInPandas(label, f"match {kind}, pid long, oid long, hitter string, label int")


def cut_tails(contacts: DataFrame, p: str, threshold: float) -> DataFrame:
    """Each point's contacts before the first one whose chance of belonging to it is below the threshold, counted anew."""
    first = F.min(F.when(F.col(p) < threshold, F.col("shot_no"))).over(Window.partitionBy("match", "pid"))
    kept = contacts.withColumn("_cut", first).filter("_cut is null or shot_no < _cut").drop("_cut")
    return kept.withColumn("rally", F.count(F.lit(1)).over(Window.partitionBy("match", "pid")))


def tail_features(contacts: DataFrame) -> DataFrame:
    """What tells a contact after the rally's end: gaps, change of them, loudness, how far from the net, what is left."""
    w = Window.partitionBy("match", "pid").orderBy("shot_no")
    t, back = F.col("t"), F.lag("t").over(w)
    rows = contacts.withColumn("gap", t - back).withColumn("gap_next", F.lead("t").over(w) - t)
    rows = rows.withColumn("gap_change", F.col("gap") - F.lag("gap").over(w)).withColumn("depth", F.abs("hy"))
    return rows.withColumn("left", F.count(F.lit(1)).over(Window.partitionBy("match", "pid")) - F.col("shot_no"))


def rally_time_features(tracks: DataFrame, onsets: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """A row for each sample with both players' places, speeds over several spans, onsets around, age of the segment; and,
    with ``points`` (match, t_start, t_last), whether the sample lies in a rally (0.3 s before to 0.8 s after)."""
    wide = tracks.groupBy("match", "seg", "t").pivot("half", list(ENDS)).agg(F.avg("cx").alias("x"), F.avg("cy").alias("y"))
    w = Window.partitionBy("match", "seg").orderBy("t")
    by, order = ["match", "seg"], ["t"]
    for end in ENDS:
        x, y = F.col(f"{end}_x"), F.col(f"{end}_y")
        wide = wide.withColumn(f"{end}_v", F.hypot(x - F.lag(x).over(w), y - F.lag(y).over(w)) / (F.col("t") - F.lag("t").over(w)))
    for end in ENDS:
        for size in (3, 7, 13, 25):
            wide = wide.withColumn(f"{end}_v{size}", F.avg(f"{end}_v").over(T.centred(by, order, size)))
        wide = wide.withColumn(f"{end}_sd", F.stddev_samp(f"{end}_x").over(T.centred(by, order, 13)))
    span = Window.partitionBy("match", "seg")
    wide = wide.withColumn("age", F.col("t") - F.min("t").over(span)).withColumn("remaining", F.max("t").over(span) - F.col("t"))
    for z in (6, 12, 30):
        loud = onsets.filter(F.col("z") >= z).select("match", "t")
        for radius in (1.0, 2.5, 5.0):
            wide = T.density(wide, loud, ["match"], "t", radius, f"n{z}_{str(radius).replace('.', '_')}")
        wide = T.asof(wide, loud, ["match"], "t", [], strict=True, prefix="_b_")
        wide = T.asof(wide, loud, ["match"], "t", [], forward=True, prefix="_f_")
        cap = lambda c: F.coalesce(F.least(c, F.lit(30.0)), F.lit(30.0))
        since, until = F.col("t") - F.col("_b_t"), F.col("_f_t") - F.col("t")
        wide = wide.withColumn(f"since{z}", F.when(since.isNull(), 30.0).otherwise(cap(since))).withColumn(f"until{z}", F.when(until.isNull(), 30.0).otherwise(cap(until))).drop("_b_t", "_f_t")
    if points is None:
        return wide
    spans = points.select("match", (F.col("t_start") - 0.3).alias("a"), (F.col("t_last") + 0.8).alias("b"))
    return T.covered(wide, spans, ["match"], "t", "a", "b")


def alignment_rates(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Of aligned points (v_ and m_ columns): shares of equal server, side and serve count."""
    same = lambda a, b: M.share(F.col(a) == F.col(b))
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), same("v_server_end", "m_server_end").alias("server"), same("v_side", "m_side").alias("side"), same("v_n_serves", "m_n_serves").alias("n_serves"))


def position_checks(shots: DataFrame, by: list[str]) -> DataFrame:
    """Whether places fit what was charted: servers behind the baseline, returners outward of the middle, how well places tell
    the serve's direction, the next shot's direction and net play."""
    w = Window.partitionBy("match", "pid").orderBy("shot_no")
    near = F.col("hitter_end") == "near"
    rows = shots.withColumn("next_x", F.lead("hx").over(w)).withColumn("prev_direction", F.lag("direction").over(w))
    rows = rows.withColumn("out_x", F.when(F.col("kind") == "serve", F.col("ox") * G.outward(~near, F.col("serve_side") == "deuce")))
    rows = rows.withColumn("receiver_x", F.when(near, -F.col("next_x")).otherwise(F.col("next_x")))
    net = F.col("family").isin("volley", "half_volley", "swinging_volley", "overhead") | F.col("modifiers").contains("-")
    serve, rally = rows.filter("kind = 'serve'"), rows.filter("kind = 'rally'").withColumn("net", net)
    base = serve.groupBy(*by).agg(M.share(F.abs("hy") >= 10.8).alias("server_behind"), F.median(F.when(F.col("direction") == "4", F.col("out_x"))).alias("wide_out"), F.median(F.when(F.col("direction") == "6", F.col("out_x"))).alias("t_out"))
    aucs = [
        M.auc(serve.filter(F.col("direction").isin("4", "6")), by, "out_x", F.col("direction") == "4").select(*by, F.col("auc").alias("auc_wide")),
        M.auc(rally.filter(F.col("direction").isin("1", "3")), by, "receiver_x", F.col("direction") == "1").select(*by, F.col("auc").alias("auc_direction")),
        M.auc(rally.withColumn("_close", -F.col("dist_net")), by, "_close", F.col("net")).select(*by, F.col("auc").alias("auc_net")),
    ]
    for a in aucs:
        base = base.join(a, by, "left")
    return base


def match_summary(aligned: DataFrame, shots: DataFrame, strokes: DataFrame) -> DataFrame:
    """A row for each match: rally agreement, position checks, and how well stroke sides are told."""
    rally = M.rally_agreement(aligned.filter("server_ok"), ["match"], "v_rally", "m_rally")
    side = strokes.groupBy("match").agg(M.share((F.col("p_forehand") >= 0.5) == (F.col("side") == "F")).alias("side_accuracy"), F.count("p_forehand").alias("side_n"))
    return rally.join(position_checks(shots, ["match"]), "match", "left").join(side, "match", "left")


def compare_strokes(a: DataFrame, b: DataFrame, truth: DataFrame) -> DataFrame:
    """Two labellers' chances of a forehand against the charted side, on contacts that both have: accuracy and AUC."""
    both = a.select("hit_id", F.col("p").alias("pa")).join(b.select("hit_id", F.col("p").alias("pb")), "hit_id").join(truth.select("hit_id", "side"), "hit_id")
    y = F.col("side") == "F"
    out = both.agg(F.count(F.lit(1)).alias("n"), M.share((F.col("pa") >= 0.5) == y).alias("accuracy_a"), M.share((F.col("pb") >= 0.5) == y).alias("accuracy_b"))
    for c in ("pa", "pb"):
        out = out.crossJoin(M.auc(both, [], c, y).select(F.col("auc").alias(f"auc_{c[1]}")))
    return out


def compare_boxes(ours: DataFrame, theirs: DataFrame, by: list[str], tolerance: float = 0.05) -> DataFrame:
    """Boxes (x1, y1, x2, y2) of two sources near in time: median and low overlap, and the feet's distance."""
    box = ["x1", "y1", "x2", "y2"]
    rows = T.nearest(ours, theirs, by, "t", box, tolerance=tolerance, prefix="o_").filter("o_x1 is not null")
    iou = G.box_iou(*[F.col(c) for c in box], *[F.col(f"o_{c}") for c in box])
    foot = F.hypot((F.col("x1") + F.col("x2") - F.col("o_x1") - F.col("o_x2")) / 2, F.col("y2") - F.col("o_y2"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.median(iou).alias("iou"), F.median(foot).alias("foot"), F.percentile(foot, F.lit(0.9)).alias("foot_p90"))
