"""Measures of agreement, all as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(flag: Column) -> Column:
    return F.avg(flag.cast("int"))


def share_if(flag: Column, least: int) -> Column:
    """The share of a flag, null for groups with fewer than ``least`` rows that have it."""
    return F.when(F.count(flag) >= least, share(flag))


def weighted_mean(x: Column, w: Column) -> Column:
    """Null as soon as a value or weight is null."""
    return F.when(F.count(F.when(x.isNull() | w.isNull(), 1)) == 0, F.try_divide(F.sum(x * w), F.sum(w)))


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the mean rank of equal values. Ranks come from counts of each value, so equal values don't meet in one
    task: only the list of different values is numbered."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    run = F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranks = counts.select(*by, value, (run - (F.col("_n") - 1) / 2).alias(name))
    return rows.join(ranks, [*by, value])


def auc(rows: DataFrame, by: list[str], score: str, label: Column) -> DataFrame:
    """The chance that a positive row scores above a negative one, ties counting half; null where a class is missing."""
    rows = rows.withColumn("_y", label.cast("int")).filter(F.col("_y").isNotNull())
    counts = rows.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum("_y").alias("_p"), F.count(F.lit(1)).alias("_n"))
    run = F.sum("_n").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, 0))
    # twice the rank keeps the sum whole
    twice = counts.select(*by, "_p", "_n", (2 * run - F.col("_n") + 1).alias("_r"))
    out = twice.groupBy(*by).agg(F.sum(F.col("_r") * F.col("_p")).alias("_s"), F.sum("_p").alias("_pos"), F.sum("_n").alias("_all"))
    pos, neg = F.col("_pos"), F.col("_all") - F.col("_pos")
    value = F.when((pos > 0) & (neg > 0), (F.col("_s") - pos * (pos + 1)).cast("double") / (2 * pos * neg).cast("double"))
    return out.select(*by, value.alias("auc"), pos.alias("n_pos"), neg.alias("n_neg"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    both = average_ranks(average_ranks(rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), [], a, "_ra"), [], b, "_rb")
    return both.agg(F.corr("_ra", "_rb").alias("spearman"), F.count(F.lit(1)).alias("n"))


def calibration(rows: DataFrame, by: list[str], p: Column, y: Column, bins: int = 10) -> DataFrame:
    """The mean gap between confidence and hit rate over ``bins`` of confidence from one half to 1, weighted by their rows."""
    conf = F.greatest(p, 1 - p)
    right = ((p >= 0.5) == y.cast("boolean")).cast("int")
    at = F.least(F.floor((conf - 0.5) * 2 * bins), F.lit(bins - 1))
    rows = rows.select(*by, conf.alias("_c"), right.alias("_r"), at.alias("_bin")).filter(F.col("_c").isNotNull() & F.col("_r").isNotNull())
    binned = rows.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.abs(F.avg("_c") - F.avg("_r")).alias("_gap"))
    return binned.groupBy(*by).agg((F.sum(F.col("_gap") * F.col("_n")) / F.sum("_n")).alias("ece"), F.sum("_n").alias("n"))


def confusion(rows: DataFrame, truth: str, predicted: str, values: list) -> DataFrame:
    """Counts of each pair of values, 0 where there is none."""
    return rows.groupBy(truth).pivot(predicted, values).count().na.fill(0)


def class_scores(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Support, precision, recall and F1 of each class that the truth has; 0 where a ratio has no denominator."""
    pairs = rows.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    support = pairs.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("hits"))
    called = pairs.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("called"))
    out = support.join(called, "class", "left").na.fill(0, ["called"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    precision, recall = ratio(F.col("hits"), F.col("called")), ratio(F.col("hits"), F.col("support"))
    return out.select("class", "support", precision.alias("precision"), recall.alias("recall"), ratio(2 * F.col("hits"), F.col("support") + F.col("called")).alias("f1"))


def macro_f1(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    hits = class_scores(rows, truth, predicted)
    return hits.agg((F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.sum("support").alias("n"))


def rally_agreement(rows: DataFrame, by: list[str], ours: str, truth: str) -> DataFrame:
    """Exact and within-one shares, bias and mean absolute error of a count, over rows that have both."""
    d = F.col(ours) - F.col(truth)
    rows = rows.filter(d.isNotNull())
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share(d == 0).alias("exact"), share(F.abs(d) <= 1).alias("within1"), F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae"))


def binary_score(rows: DataFrame, by: list[str], p: Column, y: Column, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision and recall of p > threshold, and the shares called and true."""
    hat, y = p > threshold, y.cast("boolean")
    n = lambda c: F.count(F.when(c, 1))
    at_least = lambda c: F.greatest(c, F.lit(1))
    return rows.groupBy(*by).agg(share(hat == y).alias("accuracy"), (n(hat & y) / at_least(n(hat))).alias("precision"), (n(hat & y) / at_least(n(y))).alias("recall"), share(hat).alias("share_called"), share(y).alias("share_true"))


def paired(a: DataFrame, b: DataFrame, keys: list[str], right: str) -> DataFrame:
    """Two results on the keys that both have: shares right, and how often just one is."""
    both = a.select(*keys, F.col(right).alias("_a")).join(b.select(*keys, F.col(right).alias("_b")), keys)
    return both.agg(F.count(F.lit(1)).alias("n"), share(F.col("_a")).alias("share_a"), share(F.col("_b")).alias("share_b"), F.count(F.when(F.col("_a") & ~F.col("_b"), 1)).alias("only_a"), F.count(F.when(~F.col("_a") & F.col("_b"), 1)).alias("only_b"))


def against_targets(measured: DataFrame, targets: DataFrame) -> DataFrame:
    """(metric, value) against (metric, target, at_least): whether each target is met."""
    met = F.when(F.col("at_least"), F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    return targets.join(measured, "metric", "left").select("metric", "value", "target", met.alias("met"))


def cost(ledger: DataFrame, usd_per_token: float) -> DataFrame:
    """Requests, tokens and cost by the part of the label before its first colon."""
    label = F.split(F.col("label"), ":")[0]
    return ledger.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("tokens"), F.sum(F.coalesce("usd", F.col("input_tokens") * usd_per_token)).alias("usd"))


def side_scores(rows: DataFrame, by: list[str], truth: str, p: str, positive: str = "F", negative: str = "B") -> DataFrame:
    """Number, accuracy at one half, AUC and calibration error of a chance of ``positive`` where the truth is known."""
    known = rows.filter(F.col(truth).isin(positive, negative) & F.col(p).isNotNull()).withColumn("_y", F.col(truth) == positive)
    hits = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share((F.col(p) >= 0.5) == F.col("_y")).alias("acc"))
    return hits.join(auc(known, by, p, F.col("_y")).select(*by, "auc"), by, "left").join(calibration(known, by, F.col(p), F.col("_y")).groupBy(*by).agg(F.max("ece").alias("ece")), by, "left")


def agreement(a: DataFrame, b: DataFrame, keys: list[str], label: str) -> DataFrame:
    """How many rows both tables label, and the share of these with the same label."""
    both = a.select(*keys, F.col(label).alias("_a")).join(b.select(*keys, F.col(label).alias("_b")), keys)
    return both.agg(F.count(F.lit(1)).alias("n"), share(F.col("_a") == F.col("_b")).alias("agree"))


def projected_cost(requests: DataFrame, kind: str, tokens: str, keys: list[str], counts: DataFrame, usd_per_token: float, probes: int = 3) -> DataFrame:
    """The cost of all requests of each kind (``counts``: kind, n) from the mean tokens of its first ``probes`` requests."""
    nth = F.row_number().over(Window.partitionBy(kind).orderBy(*keys))
    mean = requests.withColumn("_nth", nth).filter(F.col("_nth") <= probes).groupBy(kind).agg(F.avg(tokens).alias("tokens_per_request"))
    return counts.join(mean, kind, "left").withColumn("projected_usd", F.col("n") * F.col("tokens_per_request") * usd_per_token)
