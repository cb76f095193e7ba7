"""Court geometry as column functions, in metres from the middle of the net."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import clip

BASELINE, SERVICE, SINGLES, DOUBLES = 11.885, 6.40, 4.115, 5.485


def hitter_frame(x: Column, y: Column, far: Column) -> tuple[Column, Column]:
    """Turned by half a circle for the far end, so that the hitter's half has y < 0."""
    return F.when(far, -x).otherwise(x), F.when(far, -y).otherwise(y)


def forehand_frame(x: Column, left_handed: Column) -> Column:
    return F.when(left_handed, -x).otherwise(x)


def contact_depth(y: Column) -> Column:
    """Metres behind the baseline, in the hitter's frame."""
    return -y - BASELINE


def serve_side(x: Column, near: Column) -> Column:
    return F.when((x > 0) == near, "deuce").otherwise("ad")


def outward(near: Column, deuce: Column) -> Column:
    return F.when(near == deuce, 1).otherwise(-1)


def forehand_chance(right: Column, near: Column, hand: Column, sure: float = 0.8) -> Column:
    """The chance of a forehand from the side of the picture, the end and the hand; one half if the hand isn't known."""
    forehand = (right == near) == (hand == "R")
    return F.when(~hand.isin("R", "L") | hand.isNull(), 0.5).when(forehand, sure).otherwise(1 - sure)


def serve_score(x: Column, y: Column, ox: Column, oy: Column, speed: Column, arm: Column, z: Column) -> Column:
    """Evidence that a contact is a serve, from both players' places, speed, the arm and loudness; y and oy from the net."""
    fast = F.coalesce(speed, F.lit(9.0))
    return (
        F.when(F.abs(y) >= 10.3, 1.0).otherwise(-4.0) + F.when(F.abs(x) <= 4.8, 0.5).otherwise(-3.0)
        + F.when(F.abs(oy) >= 7, 0.5).otherwise(-3.0) + F.when(x * ox <= 0.6, 0.5).otherwise(-1.5)
        + F.when(fast <= 1.6, 0.5).otherwise(-1.0) + clip(2.5 * arm, -2.5, 2.5) + clip(0.25 * (z - 8), -1.5, 1.5)
    )


def track_prior(x: Column, y: Column, height: Column, median_height: Column, conf: Column) -> Column:
    """How well a detection suits a player of one half; y is the distance from the net."""
    off = (F.abs(x) > 8.5) | (F.abs(y) > 21)
    size = 0.5 * F.log(clip(height / median_height, 0.2, 5.0))
    wide = F.greatest(F.abs(x) - 5.2, F.lit(0.0)) * -1.5
    deep = F.greatest(F.abs(y) - 16, F.lit(0.0)) * -0.6
    return F.when(off, F.lit(None).cast("double")).otherwise(conf + F.when((F.abs(x) > 5.6) & (F.abs(y) < 3.5), -6.0).otherwise(0.0) + wide + deep + size)


def project(h: Column, x: Column, y: Column) -> Column:
    """(x, y) through a 3 x 3 projection given as an array of nine, by rows; null where it has no image."""
    e = lambda k: F.get(h, F.lit(k)).cast("double")
    w = e(6) * x + e(7) * y + e(8)
    px, py = (e(0) * x + e(1) * y + e(2)) / w, (e(3) * x + e(4) * y + e(5)) / w
    return F.when(w != 0, F.struct(px.alias("x"), py.alias("y")))


def inverse(h: Column) -> Column:
    """The adjugate, which as a projection is the inverse."""
    e = lambda k: F.get(h, F.lit(k)).cast("double")
    minor = lambda a, b, c, d: e(a) * e(d) - e(b) * e(c)
    return F.array(
        minor(4, 5, 7, 8), -minor(1, 2, 7, 8), minor(1, 2, 4, 5),
        -minor(3, 5, 6, 8), minor(0, 2, 6, 8), -minor(0, 2, 3, 5),
        minor(3, 4, 6, 7), -minor(0, 1, 6, 7), minor(0, 1, 3, 4),
    )


def blend_arrays(a: Column, b: Column, w: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (1 - w) * x + w * y)


def box_iou(ax1: Column, ay1: Column, ax2: Column, ay2: Column, bx1: Column, by1: Column, bx2: Column, by2: Column) -> Column:
    zero = F.lit(0.0)
    w = F.greatest(F.least(ax2, bx2) - F.greatest(ax1, bx1), zero)
    h = F.greatest(F.least(ay2, by2) - F.greatest(ay1, by1), zero)
    both = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - w * h
    return F.when(both > 0, w * h / both).otherwise(zero)


def square_crop(x1: Column, y1: Column, x2: Column, y2: Column, scale: float = 1.7, least: float = 64.0) -> Column:
    """A square around a box, in whole pixels: its corner, a twentieth of the side above the middle, and its side."""
    side = F.greatest(F.lit(least), scale * F.greatest(y2 - y1, 1.2 * (x2 - x1)))
    whole = lambda v: F.rint(v).cast("int")
    return F.struct(whole((x1 + x2) / 2 - side / 2).alias("x"), whole((y1 + y2) / 2 - 0.55 * side).alias("y"), whole(side).alias("side"))


def region_box(h: Column, corners: Column, width: int, height: int, top: float, beside: float, least: int = 32) -> Column:
    """The box in the picture of a region on the court: ``corners`` (an array of x, y) through the projection ``h``, padded and
    cut at the picture's edges; null if it is smaller than ``least`` either way."""
    seen = F.transform(corners, lambda c: project(h, c["x"], c["y"]))
    at = lambda f, c: f(F.transform(seen, lambda q: q[c]))
    whole = lambda v: F.floor(v).cast("int")
    x1, y1 = whole(F.greatest(at(F.array_min, "x") - beside, F.lit(0.0))), whole(F.greatest(at(F.array_min, "y") - top, F.lit(0.0)))
    x2, y2 = whole(F.least(at(F.array_max, "x") + beside, F.lit(float(width)))), whole(F.least(at(F.array_max, "y") + 0.25 * top, F.lit(float(height))))
    return F.when((x2 - x1 >= least) & (y2 - y1 >= least), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def hit_score(loud: Column, reach: Column, bias: float = -1.0, per_loud: float = 0.25, from_loud: float = 6.0, per_reach: float = 1.0) -> Column:
    """Evidence of a contact without any label: loudness and the reach of the wrist (0.6 if unseen), 6 at most either way."""
    return clip(bias + per_loud * (loud - from_loud) + per_reach * F.coalesce(reach, F.lit(0.6)) - per_reach * 0.8, -6, 6)


def keypoint(points: Column, k: int) -> Column:
    """The k-th of the (x, y, confidence) triples in a flat array."""
    return F.struct(F.get(points, F.lit(3 * k)).alias("x"), F.get(points, F.lit(3 * k + 1)).alias("y"), F.get(points, F.lit(3 * k + 2)).alias("c"))


def pose_cues(points: Column, least: float = 0.3) -> Column:
    """Cues of a 17-point pose in torso lengths: arm above the head, both arms up, reach and distance of the wrists."""
    nose, ls, rs, lw, rw, lh, rh = (keypoint(points, k) for k in (0, 5, 6, 9, 10, 11, 12))
    sy, hy, sx = (ls["y"] + rs["y"]) / 2, (lh["y"] + rh["y"]) / 2, (ls["x"] + rs["x"]) / 2
    torso = F.when(F.least(ls["c"], rs["c"], lh["c"], rh["c"]) >= least, F.greatest(hy - sy, F.lit(1e-6)))
    up = lambda w: F.when(w["c"] >= least, (nose["y"] - w["y"]) / torso)
    out = lambda w: F.when(w["c"] >= least, F.hypot(w["x"] - sx, w["y"] - sy) / torso)
    apart = F.when((lw["c"] >= least) & (rw["c"] >= least), F.hypot(lw["x"] - rw["x"], lw["y"] - rw["y"]) / torso)
    both = F.when((lw["c"] >= least) & (rw["c"] >= least), F.least(up(lw), up(rw)))
    return F.struct(F.greatest(up(lw), up(rw)).alias("arm_up"), both.alias("both_up"), F.greatest(out(lw), out(rw)).alias("wrist_ext"), apart.alias("wrists_apart"), torso.alias("torso"))


def live_view(far_y: Column, near_y: Column, cx_far: Column, cx_near: Column, near_width: Column) -> Column:
    """The seven conditions on the court's corners under which the main camera shows a rally."""
    return (
        far_y.between(0.04, 0.55) & near_y.between(0.5, 1.05) & (near_y - far_y >= 0.25)
        & cx_far.between(0.1, 0.9) & cx_near.between(0.05, 0.95) & (near_width >= 0.3)
    )
