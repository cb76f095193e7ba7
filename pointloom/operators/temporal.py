"""Joins and windows along time: as-of, nearest, interpolation, islands, densities.

Every operator takes its keys first; a key's rows share a window. For keys with too many rows for one task, asof() can work in
buckets of time: each bucket is a window of its own, and only the last row of each bucket is carried on to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, carry: list[str], order: str | None = None, forward: bool = False, strict: bool = False, tolerance: float | None = None, prefix: str = "r_", bucket: float | None = None) -> DataFrame:
    """``left`` with ``carry`` (and ``on``) of the last row of ``right`` at or before it, under ``prefix``; null if there is none.

    ``forward``: the first at or after. ``strict``: not at the same time. ``order``: a column of ``right`` that decides among
    rows of one time, the last counting (forward: the first). A carried null stays a null. ``tolerance`` in units of ``on``.
    With ``bucket`` the windows cover that much time each.
    """
    sign = -1 if forward else 1
    payload = F.struct(F.col(on).alias("t"), *[F.col(c) for c in carry])
    a = left.select("*", F.col(on).alias("_t"), F.lit(1 - 2 * int(strict)).alias("_side"), F.lit(None).cast("long").alias("_tie"))
    b = right.select(*by, F.col(on).alias("_t"), F.lit(0).alias("_side"), (F.col(order) if order else F.lit(0)).cast("long").alias("_tie"), payload.alias("_row"))
    both = a.unionByName(b, allowMissingColumns=True)
    time = [F.col("_t").asc() if sign == 1 else F.col("_t").desc(), F.col("_side").asc(), F.col("_tie").asc() if sign == 1 else F.col("_tie").desc()]
    if bucket is None:
        seen = Window.partitionBy(*by).orderBy(*time).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("_hit", F.last("_row", ignorenulls=True).over(seen))
    else:
        both = both.withColumn("_bucket", F.floor(F.col("_t") / bucket))
        seen = Window.partitionBy(*by, "_bucket").orderBy(*time).rowsBetween(Window.unboundedPreceding, 0)
        rank = F.struct(F.col("_t") * sign, F.col("_tie") * sign)
        lasts = both.filter("_row is not null").groupBy(*by, "_bucket").agg(F.max_by("_row", rank).alias("_end"))
        buckets = both.select(*by, "_bucket").distinct().join(lasts, [*by, "_bucket"], "left")
        past = Window.partitionBy(*by).orderBy(F.col("_bucket") * sign).rowsBetween(Window.unboundedPreceding, -1)
        buckets = buckets.withColumn("_before", F.last("_end", ignorenulls=True).over(past)).drop("_end")
        both = both.withColumn("_hit", F.last("_row", ignorenulls=True).over(seen)).join(buckets, [*by, "_bucket"]).withColumn("_hit", F.coalesce("_hit", "_before"))
    near = F.col("_hit")
    if tolerance is not None:
        near = F.when((F.col("_t") - F.col("_hit.t")) * sign <= tolerance, F.col("_hit"))
    hit = both.filter("_side <> 0").withColumn("_hit", near)
    return hit.select(*left.columns, F.col("_hit.t").alias(prefix + on), *[F.col(f"_hit.{c}").alias(prefix + c) for c in carry])


def nearest(left: DataFrame, right: DataFrame, by: list[str], on: str, carry: list[str], order: str | None = None, tolerance: float | None = None, prefix: str = "r_") -> DataFrame:
    """As asof(), from whichever side is nearer; the earlier one if both are as near."""
    both = asof(asof(left, right, by, on, carry, order, prefix="_b_"), right, by, on, carry, order, forward=True, prefix="_f_")
    back, ahead = F.col(on) - F.col("_b_" + on), F.col("_f_" + on) - F.col(on)
    first = F.col("_b_" + on).isNotNull() & (F.col("_f_" + on).isNull() | (back <= ahead))
    gap = F.when(first, back).otherwise(ahead)
    held = F.lit(True) if tolerance is None else F.coalesce(gap <= tolerance, F.lit(False))
    pick = lambda c: F.when(held, F.when(first, F.col("_b_" + c)).otherwise(F.col("_f_" + c))).alias(prefix + c)
    return both.select(*left.columns, pick(on), *[pick(c) for c in carry])


def lerp(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], order: str | None = None, tolerance: float | None = None, prefix: str = "at_") -> DataFrame:
    """``values`` of ``right`` at the times of ``left`` on the line between the samples beside; the end's value outside.

    Null where no sample lies within ``tolerance``.
    """
    both = asof(asof(left, right, by, on, values, order, prefix="_b_"), right, by, on, values, order, forward=True, prefix="_f_")
    t, t0, t1 = F.col(on), F.col("_b_" + on), F.col("_f_" + on)
    held = F.lit(True) if tolerance is None else (F.least(F.abs(t - t0), F.abs(t1 - t)) <= tolerance)

    def at(c: str) -> Column:
        x0, x1 = F.col("_b_" + c), F.col("_f_" + c)
        line = F.when(t1 > t0, x0 + (x1 - x0) * ((t - t0) / (t1 - t0))).otherwise(x0)
        return F.when(held, F.when(t0.isNull(), x1).when(t1.isNull(), x0).otherwise(line)).alias(prefix + c)

    return both.select(*left.columns, *[at(c) for c in values])


def in_interval(events: DataFrame, intervals: DataFrame, by: list[str], on: str, start: str, end: str, carry: list[str]) -> DataFrame:
    """Each event with the interval that holds it (both ends count; intervals of a key don't overlap), else nulls."""
    ends = intervals.select(*by, F.col(start).alias(on), F.col(end).alias("_end"), *carry)
    hit = asof(events, ends, by, on, ["_end", *carry], prefix="_i_")
    inside = F.col(on) <= F.col("_i__end")
    return hit.select(*events.columns, *[F.when(inside, F.col("_i_" + c)).alias(c) for c in carry])


def covered(samples: DataFrame, intervals: DataFrame, by: list[str], on: str, start: str, end: str, flag: str = "y") -> DataFrame:
    """Whether any interval, overlapping ones too, holds the sample: openings less closings up to its time."""
    a = samples.select("*", F.col(on).alias("_t"), F.lit(1).alias("_side"), F.lit(0).alias("_d"))
    up = intervals.select(*by, F.col(start).alias("_t"), F.lit(0).alias("_side"), F.lit(1).alias("_d"))
    down = intervals.select(*by, F.col(end).alias("_t"), F.lit(2).alias("_side"), F.lit(-1).alias("_d"))
    both = a.unionByName(up, allowMissingColumns=True).unionByName(down, allowMissingColumns=True)
    run = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_open", F.sum("_d").over(run)).filter("_side = 1").select(*samples.columns, (F.col("_open") > 0).alias(flag))


def islands(rows: DataFrame, by: list[str], on: str, gap: float, tie: list[str], name: str = "island") -> DataFrame:
    """Rows with the number, from 0, of their run: a run ends where the next row comes more than ``gap`` later."""
    w = Window.partitionBy(*by).orderBy(on, *tie)
    breaks = (F.col(on) - F.lag(on).over(w) > gap).cast("int")
    rows = rows.withColumn("_break", F.coalesce(breaks, F.lit(0)))
    return rows.withColumn(name, F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def segments(rows: DataFrame, by: list[str], on: str, gap: float = 2.01, least: float = 2.0) -> DataFrame:
    """Runs as intervals: those shorter than ``least`` dropped, then both ends moved out by half the median step of the key."""
    w = Window.partitionBy(*by).orderBy(on)
    step = rows.withColumn("_step", F.col(on) - F.lag(on).over(w)).groupBy(*by).agg(F.coalesce(F.median("_step"), F.lit(1.0)).alias("_step"))
    runs = islands(rows, by, on, gap, []).groupBy(*by, "island").agg(F.min(on).alias("_a"), F.max(on).alias("_b")).filter(F.col("_b") - F.col("_a") >= least)
    half = F.col("_step") / 2
    return runs.join(step, by).select(*by, "island", (F.col("_a") - half).alias("start"), (F.col("_b") + half).alias("end"), (F.col("_b") - F.col("_a") + F.col("_step")).alias("dur"))


def ticks(on: str, *spans: int | float) -> tuple[Column, list[int]]:
    """An order and spans for a range window: as they are if whole, else in millionths, as Spark takes whole numbers only."""
    if all(isinstance(s, int) for s in spans):
        return F.col(on), list(spans)
    return F.round(F.col(on) * 1_000_000).cast("long"), [round(s * 1_000_000) for s in spans]


def density(samples: DataFrame, events: DataFrame, by: list[str], on: str, radius: int | float, name: str) -> DataFrame:
    """How many events lie in [t - radius, t + radius) of each sample."""
    a = samples.select("*", F.col(on).alias("_t"), F.lit(1).alias("_side"))
    both = a.unionByName(events.select(*by, F.col(on).alias("_t"), F.lit(0).alias("_side")), allowMissingColumns=True)
    one = F.when(F.col("_side") == 0, 1)
    at, (r,) = ticks("_t", radius)
    w = Window.partitionBy(*by).orderBy(at)
    upto = F.count(one).over(w.rangeBetween(-r, r)) - F.count(one).over(w.rangeBetween(r, r))
    return both.withColumn(name, upto).filter("_side = 1").select(*samples.columns, name)


def quiet_before(events: DataFrame, by: list[str], on: str, loud: Column, far: int | float, near: int | float, name: str = "quiet") -> DataFrame:
    """Whether none of a key's events from ``far`` to ``near`` before this one (both count) is loud."""
    at, (a, b) = ticks(on, far, near)
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(-a, -b)
    return events.withColumn(name, F.coalesce(F.max(loud.cast("int")).over(w), F.lit(0)) == 0)


def centred(by: list[str], order: list[str], size: int) -> Window:
    """A window of ``size`` rows around each row."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(-(size // 2), size // 2)


def median3(x: str, by: list[str], order: list[str]) -> Column:
    """The median of a row's value and its neighbours'; with one neighbour the mean of both, with none the value."""
    w = Window.partitionBy(*by).orderBy(*order)
    a, b, c = F.lag(x).over(w), F.col(x), F.lead(x).over(w)
    middle = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    return F.when(a.isNull() & c.isNull(), b).when(a.isNull(), (b + c) / 2).when(c.isNull(), (a + b) / 2).otherwise(middle)


def running_median(x: str, by: list[str], order: list[str], size: int) -> Column:
    """The median of any centred window: its values as a sorted list, the middle one or the mean of the middle two."""
    values = F.array_sort(F.collect_list(x).over(centred(by, order, size)))
    n = F.size(values)
    low, high = F.get(values, F.floor((n - 1) / 2).cast("int")), F.get(values, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def running_spread(rows: DataFrame, x: str, by: list[str], order: list[str], size: int) -> DataFrame:
    """``median`` of the centred window, and ``mad``, the same of the distances from it."""
    rows = rows.withColumn("median", running_median(x, by, order, size)).withColumn("_off", F.abs(F.col(x) - F.col("median")))
    return rows.withColumn("mad", running_median("_off", by, order, size)).drop("_off")


def same_time(left: DataFrame, right: DataFrame, by: list[str], on: str, carry: list[str], prefix: str = "r_") -> DataFrame:
    """``left`` with ``carry`` of the row of ``right`` at the same time to a microsecond; null if there is none."""
    tick = F.round(F.col(on) * 1_000_000).cast("long")
    told = right.withColumn("_tick", tick).groupBy(*by, "_tick").agg(*[F.max_by(c, on).alias(prefix + c) for c in carry])
    return left.withColumn("_tick", tick).join(told, [*by, "_tick"], "left").select(*left.columns, *[prefix + c for c in carry])


def blend_at(left: DataFrame, right: DataFrame, by: list[str], on: str, array: str, longest: float = 2.0, name: str = "blended") -> DataFrame:
    """An array of numbers of ``right`` at the times of ``left``: on the line between the samples beside, the nearer one's where
    these are more than ``longest`` apart (the later one on a tie), the first or last outside; null without any."""
    both = asof(asof(left, right, by, on, [array], prefix="_b_", strict=True), right, by, on, [array], forward=True, prefix="_f_")
    before, after, t = F.col("_b_" + on), F.col("_f_" + on), F.col(on)
    a, b, w = F.col("_b_" + array), F.col("_f_" + array), (t - before) / (after - before)
    mixed = F.zip_with(a, b, lambda x, y: (1 - w) * x + w * y)
    far = after - before > longest
    value = F.when(before.isNull(), b).when(after.isNull(), a).when(far & (t - before < after - t), a).when(far, b).otherwise(mixed)
    return both.select(*left.columns, value.alias(name))


def path_length(rows: DataFrame, by: list[str], order: list[str], x: str, y: str, longest: float, name: str = "distance") -> DataFrame:
    """The sum of the steps between rows that follow each other, without steps of ``longest`` or more."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    rows = rows.withColumn("_step", step)
    return rows.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_step") < longest, F.col("_step"))), F.lit(0.0)).alias(name))
