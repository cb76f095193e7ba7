"""Classifiers on MLlib, trained and judged by folds of matches."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folds(rows: DataFrame, group: str, most: int = 15, k: int = 5) -> DataFrame:
    """``rows`` with a fold: each group its own up to ``most`` groups, else ``k`` folds by the groups' order in turn."""
    groups = rows.select(group).distinct()
    numbered = groups.selectExpr(group, f"row_number() over (order by {group}) - 1 as _g", "count(*) over () as _n")
    fold = F.when(F.col("_n") <= most, F.col("_g")).otherwise(F.col("_g") % k)
    return rows.join(numbered.select(group, fold.cast("int").alias("fold")), group)


def with_gaps(features: list[str]) -> tuple[list, list[str]]:
    """Stages that fill missing features by the median, and the names to use; a gap is a feature of its own beside it."""
    filled = [f"{c}_filled" for c in features]
    return [Imputer(strategy="median", inputCols=features, outputCols=filled)], filled


def binary(features: list[str], label: str = "label", weight: str | None = None, rounds: int = 20, depth: int = 4, seed: int = 7) -> Pipeline:
    """Boosted trees for a 0/1 label, over double columns that may hold nulls."""
    stages, filled = with_gaps(features)
    gbt = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed)
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=filled, outputCol="_x"), gbt.setWeightCol(weight) if weight else gbt])


def multiclass(features: list[str], label: str, trees: int = 40, depth: int = 6, seed: int = 7) -> Pipeline:
    stages, filled = with_gaps(features)
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip"), *stages, VectorAssembler(inputCols=filled, outputCol="_x"), forest])


def balanced(rows: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weights under which all classes count alike."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    weight = F.col("_all") / (F.col("_k") * F.col("_n"))
    return rows.join(counts.crossJoin(F.broadcast(totals)).select(label, weight.alias(name)), label)


def chance(model: PipelineModel, rows: DataFrame, name: str = "p") -> DataFrame:
    """``rows`` with the chance of class 1."""
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).select(*rows.columns, name)


def log_odds(p: Column, base: Column, bias: float = 0.0) -> Column:
    """Evidence against the base rate."""
    safe = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(safe / (1 - safe)) - F.log(base / (1 - base)) + bias


def out_of_fold(rows: DataFrame, pipeline: Pipeline, label: str, name: str = "p") -> DataFrame:
    """Every row's chance from a model that hasn't seen its fold. ``rows`` has a fold column; a loop over folds, not rows."""
    rows = rows.cache()
    out = None
    for k in [r["fold"] for r in rows.select("fold").distinct().orderBy("fold").collect()]:
        model = pipeline.fit(rows.filter((F.col("fold") != k) & F.col(label).isNotNull()))
        own = chance(model, rows.filter(F.col("fold") == k), name)
        out = own if out is None else out.unionByName(own)
    return out


def calibrated(scored: DataFrame, p: str, label: str) -> DataFrame:
    """``p`` made to rise with the share of label 1, by isotonic regression on the same rows."""
    model = IsotonicRegression(featuresCol="_f", labelCol=label).fit(VectorAssembler(inputCols=[p], outputCol="_f").transform(scored))
    return model.transform(VectorAssembler(inputCols=[p], outputCol="_f").transform(scored)).select(*scored.columns, F.col("prediction").alias(f"{p}_calibrated"))


def self_train(rows: DataFrame, pipeline: Pipeline, relabel, rounds: int = 3, label: str = "label") -> PipelineModel:
    """Fits, lets ``relabel(rows with p)`` give new labels, and fits again."""
    model = pipeline.fit(rows)
    for _ in range(rounds - 1):
        rows = relabel(chance(model, rows)).select(*rows.columns)
        model = pipeline.fit(rows)
    return model


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
