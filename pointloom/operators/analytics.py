"""The report's tables: grids, zones, win maps, distributions, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import share, share_if


def ladder(x: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The first name whose bound x is below, else ``last``; null for null."""
    first = F.when(x.isNull(), F.lit(None).cast("string"))
    return reduce(lambda w, s: w.when(x < s[0], s[1]), steps, first).otherwise(last)


def bucket(x: Column, low: float, step: float, high: float) -> Column:
    """The lower edge of x's cell, half-open; null outside [low, high)."""
    return F.when((x >= low) & (x < high), low + F.floor((x - low) / step) * F.lit(float(step)))


def histogram2d(rows: DataFrame, by: list[str], x: Column, y: Column, xs: tuple[float, float], ys: tuple[float, float], cell: float) -> DataFrame:
    """Counts by cell, row 0 at the largest y; the upper edges belong to the last cells, points outside to none."""
    nx, ny = round((xs[1] - xs[0]) / cell), round((ys[1] - ys[0]) / cell)
    col = F.least(F.floor((x - xs[0]) / cell), F.lit(nx - 1))
    row = ny - 1 - F.least(F.floor((y - ys[0]) / cell), F.lit(ny - 1))
    inside = x.between(*xs) & y.between(*ys)
    return rows.filter(inside).groupBy(*by, row.cast("int").alias("row"), col.cast("int").alias("col")).agg(F.count(F.lit(1)).alias("n"))


def blurred(grid: DataFrame, by: list[str], sigma: float, cell: float, shape: tuple[int, int]) -> DataFrame:
    """A Gaussian blur of a sparse grid: every cell spreads to its neighbours up to four sigma, mirrored at the edges."""
    reach = int(4 * sigma / cell + 0.5)
    k = F.sequence(F.lit(-reach), F.lit(reach))
    weight = lambda c: F.exp(-0.5 * F.pow(c * cell / sigma, F.lit(2.0)))
    norm = sum(__import__("math").exp(-0.5 * (i * cell / sigma) ** 2) for i in range(-reach, reach + 1))
    for axis, size in (("row", shape[0]), ("col", shape[1])):
        spread = grid.withColumn("_d", F.explode(k))
        at = F.pmod(F.col(axis) + F.col("_d"), F.lit(2 * size))
        at = F.when(at < size, at).otherwise(2 * size - 1 - at).cast("int")
        other = "col" if axis == "row" else "row"
        grid = spread.select(*by, other, at.alias(axis), (F.col("n") * weight(F.col("_d")) / norm).alias("n")).groupBy(*by, "row", "col").agg(F.sum("n").alias("n"))
    return grid


def shared_scale(grid: DataFrame, panel: list[str], cell: float) -> DataFrame:
    """Each panel's densities as shares of its rows, over the largest of all panels; and each panel's peak in % per square metre."""
    grid = grid.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy(*panel)))
    top = grid.agg(F.max("density").alias("_top"))
    peak = F.max("density").over(Window.partitionBy(*panel)) * 100 / (cell * cell)
    return grid.withColumn("peak", peak).crossJoin(F.broadcast(top)).select(*panel, "row", "col", "n", (F.col("density") / F.col("_top")).alias("scaled"), "peak")


def zone_table(rows: DataFrame, x: Column, depth: Column) -> DataFrame:
    """Shares of all rows in six bands of depth and three thirds of width."""
    band = ladder(depth, [(-5.485, "1 inside service line"), (0.0, "2 inside baseline"), (1.0, "3 0-1 m"), (2.0, "4 1-2 m"), (3.0, "5 2-3 m")], "6 3+ m")
    third = F.when(x < -1.37, "left").when(x <= 1.37, "middle").when(x > 1.37, "right")
    table = rows.select(band.alias("band"), third.alias("third")).groupBy("band").agg(*[F.count(F.when(F.col("third") == t, 1)).alias(t) for t in ("left", "middle", "right")], F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("_all"))
    return table.crossJoin(F.broadcast(total)).select("band", "n", *[(F.col(t) / F.col("_all")).alias(t) for t in ("left", "middle", "right")])


def win_map(rows: DataFrame, x: Column, depth: Column, won: Column, least: int = 40) -> DataFrame:
    """The share won in cells of 1.5 m with at least ``least`` rows that know the winner."""
    cells = rows.select(bucket(x, -6.75, 1.5, 6.75).alias("x"), bucket(depth, -4.5, 1.5, 7.5).alias("depth"), won.alias("_won"))
    out = cells.dropna().groupBy("x", "depth").agg(F.count(F.lit(1)).alias("n"), share(F.col("_won")).alias("won"))
    return out.filter(F.col("n") >= least)


def depth_band(depth: Column) -> Column:
    return ladder(depth, [(0.0, "inside"), (1.0, "0-1 m"), (2.0, "1-2 m"), (3.0, "2-3 m"), (4.0, "3-4 m")], "4+ m")


def win_by_band(rows: DataFrame, band: Column, won: Column) -> DataFrame:
    return rows.select(band.alias("band"), won.alias("_won")).filter("_won is not null").groupBy("band").agg(F.count(F.lit(1)).alias("n"), share(F.col("_won")).alias("won"))


def length_bucket(n: Column) -> Column:
    return F.when(n <= 4, "1-4").when(n <= 8, "5-8").when(n.isNotNull(), "9+")


def length_distribution(rows: DataFrame, source: str, length: str, cap: int = 15) -> DataFrame:
    """For every length from 0 to ``cap`` (and longer) and source, the share of its rows; 0 where there is none."""
    known = rows.filter(F.col(length).isNotNull()).groupBy(source, F.least(F.col(length), F.lit(cap)).cast("int").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    spine = known.select(source).distinct().select(source, F.explode(F.sequence(F.lit(0), F.lit(cap))).alias("length"))
    full = spine.join(known, [source, "length"], "left").na.fill(0, ["n"])
    return full.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(source)))


def share_by_bin(rows: DataFrame, x: Column, flag: Column, low: float, high: float, step: float, least: int, kind: Column | None = None) -> DataFrame:
    """The share of a flag in bins of x, for all bins, null where fewer than ``least`` rows fall; one column for each kind."""
    n = round((high - low) / step)
    at = F.when((x >= low) & (x < high), F.floor((x - low) / step)).cast("int")
    kind = F.lit("all") if kind is None else kind
    known = rows.select(at.alias("bin"), flag.alias("_f"), kind.alias("kind")).dropna().groupBy("kind", "bin").agg(F.count(F.lit(1)).alias("n"), share_if(F.col("_f"), least).alias("share"))
    spine = known.select("kind").distinct().select("kind", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    return spine.join(known, ["kind", "bin"], "left").select("kind", "bin", (low + (F.col("bin") + 0.5) * F.lit(float(step))).alias("centre"), F.coalesce("n", F.lit(0)).alias("n"), "share")


def crossing(bins: DataFrame, level: float = 0.5) -> DataFrame:
    """Where the share first crosses the level, on the line between two bins' centres; empty if it never does."""
    w = Window.partitionBy("kind").orderBy("bin")
    ahead = bins.select("kind", "bin", "centre", "share", F.lead("centre").over(w).alias("_c"), F.lead("share").over(w).alias("_s"))
    hits = ahead.filter(((F.col("share") - level) * (F.col("_s") - level) <= 0) & (F.col("share") != F.col("_s")))
    at = F.col("centre") + (F.lit(level) - F.col("share")) * (F.col("_c") - F.col("centre")) / (F.col("_s") - F.col("share"))
    return hits.groupBy("kind").agg(F.min_by(at, "bin").alias("at"))


def dumbbell(rows: DataFrame, player: str, attempt: str, depth: str, least_first: int = 30, least_second: int = 12) -> DataFrame:
    """Median depth of each player against first and second serves, and the step between them, the largest first."""
    of = lambda k: F.when(F.col(attempt) == k, F.col(depth))
    out = rows.groupBy(player).agg(F.count(of(1)).alias("n_first"), F.count(of(2)).alias("n_second"), F.median(of(1)).alias("first"), F.median(of(2)).alias("second"))
    out = out.filter((F.col("n_first") >= least_first) & (F.col("n_second") >= least_second))
    return out.withColumn("step", F.col("first") - F.col("second")).orderBy(F.desc("step"), player)


def opponents(hits: DataFrame, match: str, player: str) -> DataFrame:
    """(match, player, opponent) for matches with just two players."""
    who = hits.filter(F.col(player).isNotNull()).groupBy(match).agg(F.array_sort(F.collect_set(player)).alias("_p")).filter(F.size("_p") == 2)
    rows = who.select(match, F.explode(F.array(F.struct(F.col("_p")[0].alias(player), F.col("_p")[1].alias("opponent")), F.struct(F.col("_p")[1].alias(player), F.col("_p")[0].alias("opponent")))).alias("r"))
    return rows.select(match, f"r.{player}", "r.opponent")


def serve_setup(rows: DataFrame, attempt: str, measures: list[str]) -> DataFrame:
    return rows.filter(F.col(attempt).isin(1, 2)).groupBy(attempt).agg(F.count(F.lit(1)).alias("n"), *[F.median(m).alias(m) for m in measures])


def match_summary(samples: DataFrame, match: str, depth: str, x: str, net: Column, rate: float = 4.0) -> DataFrame:
    """Hours, median depth, share at the net and spread to the side of each match's samples."""
    return samples.groupBy(match).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / rate / 3600).alias("hours"), F.median(depth).alias("median_depth"), share(net).alias("net_share"), F.stddev_samp(x).alias("lateral_sd"))


def fingerprints(rows: DataFrame, player: str, depth: str, forehand: Column, hand: str, least: int = 150) -> DataFrame:
    """Players with enough shots: median depth, shares inside the baseline and of forehands, and their commonest hand."""
    out = rows.groupBy(player).agg(F.count(F.lit(1)).alias("shots"), F.median(depth).alias("depth"), share(F.col(depth) < 0).alias("inside"), share(forehand).alias("forehand"), F.mode(hand, True).alias("hand"))
    return out.filter(F.col("shots") >= least).orderBy("depth", player)


def occupancy(samples: DataFrame, keys: list[str], p: str, pairs: dict[str, tuple[str, str]], threshold: float = 0.5) -> DataFrame:
    """Both players' places in rally time as rows, each in its own half (y < 0): ``pairs`` names the columns of each end;
    the far end's are turned."""
    ends = [F.struct(F.lit(end).alias("end"), (F.col(x) * (1 if end == "near" else -1)).alias("x"), (F.col(y) * (1 if end == "near" else -1)).alias("y")) for end, (x, y) in pairs.items()]
    rows = samples.filter(F.col(p) > threshold).select(*keys, F.explode(F.array(*ends)).alias("r")).select(*keys, "r.*")
    return rows.filter(F.col("y") < 0)


def distance_run(points: DataFrame, samples: DataFrame, by: list[str], start: str, end: str, on: str, x: str, y: str, longest: float = 2.5, least: int = 3) -> DataFrame:
    """Metres run in each point from samples of its time span, if there are ``least`` and all of one segment (column seg).

    Points of a key don't overlap, so a sample finds its point as the last that began before it.
    """
    from .temporal import in_interval, path_length

    held = in_interval(samples, points, by, on, start, end, ["pid"]).filter("pid is not null")
    good = held.groupBy(*by, "pid").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("seg").alias("_s")).filter((F.col("_n") >= least) & (F.col("_s") == 1)).select(*by, "pid")
    return path_length(held.join(good, [*by, "pid"]), [*by, "pid"], [on], x, y, longest)


def medians_by_end(serves: DataFrame, returns: DataFrame, end: str, depth: str) -> DataFrame:
    """The median depth of the server by the server's end and of the returner by the other one: role, end and median."""
    flipped = F.when(F.col(end) == "near", "far").otherwise("near")
    rows = serves.select(F.lit("server").alias("role"), F.col(end).alias("end"), F.col(depth).alias("_d")).unionByName(returns.select(F.lit("returner").alias("role"), flipped.alias("end"), F.col(depth).alias("_d")))
    return rows.groupBy("role", "end").agg(F.median("_d").alias("depth"))


def medians_by_era(rows: DataFrame, year: str, value: str, eras: tuple[tuple[int, int], ...] = ((2001, 2010), (2011, 2020), (2021, 2025))) -> DataFrame:
    """Number and median of each range of years."""
    at = F.coalesce(*[F.when(F.col(year).between(a, b), F.lit(a)) for a, b in eras])
    return rows.withColumn("first_year", at).filter("first_year is not null").groupBy("first_year").agg(F.count(F.lit(1)).alias("n"), F.median(value).alias("median"))
