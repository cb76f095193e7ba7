"""Connected components by alternating contraction, all of it in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(u, v)`` longs -> ``(node, component)`` with the smallest node of each component.

    In every round each vertex takes the least vertex among itself and its neighbours as its new name, and the edges
    are renamed, so that the graph shrinks. Even rounds order vertices by value, which folds a star around its least
    vertex at once; odd rounds order by a fresh hash, which shrinks any graph, long chains too, by a constant factor
    in expectation. Nulls and loops are ignored; an empty input gives an empty result. Vertices without an edge don't
    come back: the caller keeps them as their own component.
    """
    edges = scratch.save(edges.filter("u <> v").select("u", "v").distinct())
    assign = None
    round_ = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if round_ % 2 == 0:
            parent = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        else:
            seed = F.lit(round_)
            parent = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", seed).alias("h"), F.col("v"))).alias("m"))
            own = F.struct(F.xxhash64("u", seed).alias("h"), F.col("u").alias("v"))
            parent = parent.select("u", F.least("m", own)["v"].alias("p"))
        parent = scratch.save(parent)
        named = parent.select(F.col("u").alias("label"), F.col("p"))
        if assign is None:
            new = parent.select(F.col("u").alias("node"), F.col("p").alias("label"))
        else:
            new = assign.join(named, "label", "left").select("node", F.coalesce("p", "label").alias("label"))
        new = scratch.save(new)
        pu = parent.select(F.col("u"), F.col("p").alias("pu"))
        pv = parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        fresh = edges.join(pu, "u").join(pv, "v").filter("pu <> pv")
        fresh = scratch.save(fresh.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        scratch.drop(edges, parent, *([assign] if assign is not None else []))
        edges, assign, round_ = fresh, new, round_ + 1
    if assign is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    least = assign.groupBy("label").agg(F.min("node").alias("component"))
    return scratch.save(assign.join(least, "label").select("node", "component"))
