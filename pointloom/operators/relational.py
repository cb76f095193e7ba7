"""Keyed tables: the latest row, upserts, overwrites, look-ups, pairings, copies, record linkage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key of a log, in the order of these columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose key isn't in ``new``, and all of ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def unseen(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't done: the work that is left of a stage."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def overwrite(rows: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``rows`` with ``values`` of the matching row of ``new`` where that has one, else its own."""
    fresh = new.select(*keys, *[F.col(v).alias("_new_" + v) for v in values])
    joined = rows.join(fresh, keys, "left")
    return joined.select(*[F.coalesce("_new_" + c, c).alias(c) if c in values else F.col(c) for c in rows.columns])


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """``rows`` with columns of a small table; defaults where the key isn't there. Spark sends the table whole if its size allows."""
    joined = rows.join(table.select(*keys, *defaults, F.lit(True).alias("_there")), keys, "left")
    return joined.select(*rows.columns, *[F.when(F.col("_there"), F.col(c)).otherwise(F.lit(d)).alias(c) for c, d in defaults.items()])


def pair_by_position(a: DataFrame, b: DataFrame, keys: list[str], order_a: list[str], order_b: list[str], number: str = "rn") -> DataFrame:
    """The k-th row of a key in ``a`` with the k-th in ``b``, up to the shorter of both."""
    numbered = lambda df, order: df.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered(a, order_a).join(numbered(b, order_b), [*keys, number])


def best_of_group(rows: DataFrame, keys: list[str], value: Column, by: Column, name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, by).alias(name))


def whole_copies(rows: DataFrame, key: str, number: str, file_order: str, score: Column, chars: Column) -> tuple[DataFrame, DataFrame]:
    """Of a key that was entered several times, the best copy as a whole; and how many rows of each key went.

    The k-th occurrence of a number belongs to copy k. The copy with the least ``score``, then the most ``chars``, then the
    least k stays; rows that then still are equal in all columns but the file's order count once.
    """
    w = Window.partitionBy(key, number).orderBy(file_order)
    numbered = rows.withColumn("_copy", F.row_number().over(w) - 1)
    sums = numbered.groupBy(key, "_copy").agg(F.sum(score).alias("_s"), F.sum(chars).alias("_c"))
    best = sums.groupBy(key).agg(F.max_by("_copy", F.struct(-F.col("_s"), F.col("_c"), -F.col("_copy"))).alias("_copy"))
    kept = numbered.join(best, [key, "_copy"]).drop("_copy")
    kept = kept.dropDuplicates([c for c in rows.columns if c != file_order]).select(*rows.columns)
    gone = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(kept.groupBy(key).agg(F.count(F.lit(1)).alias("_k")), key)
    return kept, gone.select(key, (F.col("_n") - F.col("_k")).alias("dropped"))


def _first_two(hits: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Of each key the first two rows with unlike ``name``; two are enough where a row may not be its own partner."""
    once = hits.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, name).orderBy(*order))).filter("_k = 1")
    return once.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, name))).filter("_k <= 2").drop("_k")


def link_two_phase(left: DataFrame, right: DataFrame, block: list[str], left_names: tuple[str, str], right_names: tuple[str, str], left_id: str, right_id: str, prefer: list[Column], within: bool = False) -> DataFrame:
    """Rows of both sides about the same pair of players: by the key of both surnames, else by words that both names share.

    ``block`` columns must be equal. Of several partners the first by ``prefer`` stays. ``within``: both sides are the same
    rows, and none is its own partner. A row meets the two best partners of its key or words, not all rows of its block.
    """
    def made(df: DataFrame, names: tuple[str, str]) -> DataFrame:
        one, two = C.fold_name(F.col(names[0])), C.fold_name(F.col(names[1]))
        return df.withColumn("_key", C.pair_key(C.surname(one), C.surname(two))).withColumn("_one", C.tokens(one)).withColumn("_two", C.tokens(two))

    def words(df: DataFrame, one: str, two: str) -> DataFrame:
        return df.withColumn("_x", F.explode(one)).withColumn("_y", F.explode(two)).drop("_key", "_one", "_two")

    a = made(left, left_names).select(*block, left_id, "_key", "_one", "_two")
    order = [F.col(f"_p{i}").asc_nulls_last() for i in range(len(prefer))]
    b = made(right, right_names).select(*block, right_id, "_key", "_one", "_two", *[c.alias(f"_p{i}") for i, c in enumerate(prefer)])
    other = F.col(left_id) != F.col(right_id) if within else F.lit(True)
    exact = a.drop("_one", "_two").join(_first_two(b.drop("_one", "_two"), [*block, "_key"], order, right_id), [*block, "_key"]).filter(other).drop("_key").withColumn("phase", F.lit(1))
    rest = words(a.join(exact.select(left_id).distinct(), left_id, "left_anti"), "_one", "_two")
    either = words(b, "_one", "_two").unionByName(words(b, "_two", "_one"))
    loose = rest.join(_first_two(either, [*block, "_x", "_y"], order, right_id), [*block, "_x", "_y"]).filter(other).drop("_x", "_y").withColumn("phase", F.lit(2))
    w = Window.partitionBy(left_id).orderBy(*order, right_id)
    return exact.unionByName(loose).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(left_id, right_id, "phase")


def link_unique(left: DataFrame, right: DataFrame, block: list[str], needle: Column, hay: Column, left_id: str, right_id: str) -> DataFrame:
    """Pairs in a block whose ``hay`` (of right) holds ``needle`` (of left), where left has just one such partner."""
    a, b = left.select(*block, left_id, needle.alias("_needle")), right.select(*block, right_id, hay.alias("_hay"))
    hits = a.join(b, block).filter((F.length("_needle") > 0) & F.col("_hay").contains(F.col("_needle")))
    return hits.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(left_id))).filter("_n = 1").select(left_id, right_id)


def link_unique_within(rows: DataFrame, block: list[str], needle: Column, hay: Column, id_col: str, partner: str) -> DataFrame:
    """``link_unique`` of rows with all others of the same table; ids must be unique.

    Different needles meet different hays with the number of rows, the least and the greatest id. A row that hits itself has one
    partner if two rows hit: the one of them that it isn't.
    """
    t = rows.select(*block, F.col(id_col).alias("_id"), needle.alias("_needle"), hay.alias("_hay")).filter(F.col("_id").isNotNull())
    hays = t.groupBy(*block, "_hay").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_a"), F.max("_id").alias("_b"))
    hits = t.select(*block, "_needle").distinct().join(hays, block).filter((F.length("_needle") > 0) & F.col("_hay").contains(F.col("_needle")))
    hits = hits.groupBy(*block, "_needle").agg(F.sum("_n").alias("_n"), F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    own = F.coalesce(F.col("_hay").contains(F.col("_needle")), F.lit(False)).cast("int")
    one = t.withColumn("_own", own).join(hits, [*block, "_needle"]).filter("_n - _own = 1")
    return one.select(F.col("_id").alias(id_col), F.when(F.col("_a") == F.col("_id"), F.col("_b")).otherwise(F.col("_a")).alias(partner))


def tiers(names: DataFrame, key: str, **parts: DataFrame) -> DataFrame:
    """The name of the first part, in the order given, that has a row's key; ``none`` if no part has it."""
    out, tier = names, F.lit("none")
    for part, df in reversed(parts.items()):
        out = out.join(df.select(key).distinct().withColumn(f"_{part}", F.lit(True)), key, "left")
        tier = F.when(F.col(f"_{part}"), part).otherwise(tier)
    return out.select(*names.columns, tier.alias("tier"))


def export(rows: DataFrame, names: dict[str, str], integers: list[str], source: str, truth: DataFrame | None = None, on: list[str] | None = None, prefix: str = "charted_") -> DataFrame:
    """Columns under their public names, some as integers, with the truth's columns under a prefix and where rows come from."""
    if truth is not None:
        told = truth.select(*on, *[F.col(c).alias(prefix + c) for c in truth.columns if c not in on])
        rows = rows.join(told, on, "left")
        names = names | {prefix + c: prefix + c for c in truth.columns if c not in on}
    cols = [(F.col(c).try_cast("long") if c in integers else F.col(c)).alias(n) for c, n in names.items()]
    return rows.select(*cols, F.lit(source).alias("source"))


def fit_columns(rows: DataFrame, wanted: list[str], kind: str = "double") -> DataFrame:
    """Just these columns, null where ``rows`` has none by that name."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c in wanted])


def numeric_columns(rows: DataFrame, prefix: str = "") -> list[str]:
    return [f.name for f in rows.schema if f.name.startswith(prefix) and f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")]


def sample_rows(rows: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` different rows in the order of a digest of seed and keys: the same ones in every run, whatever the partitions."""
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    return rows.withColumn("_mark", mark).orderBy("_mark", *keys).limit(n).drop("_mark")


def side_by_side(a: DataFrame, b: DataFrame, keys: list[str], order_a: list[str], order_b: list[str], number: str = "rn") -> DataFrame:
    """Rows of both tables with the same number within ``keys``, in one row; nulls where one table is shorter."""
    counted = lambda df, order: df.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return counted(a, order_a).join(counted(b, order_b), [*keys, number], "full")


def isolated(rows: DataFrame, by: list[str], function, fields: str) -> DataFrame:
    """``function`` (a pandas frame to one) for each group of ``by``, with a column ``error``: a group that fails gives one row
    with its keys and the error's text, and the others go on. ``fields`` are the result's columns, the keys first."""
    import pandas as pd

    names = [f.strip().split(" ")[0] for f in fields.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return function(pdf).assign(error=None)[[*names, "error"]]
        except Exception as e:  # noqa: BLE001
            return pd.DataFrame([{k: pdf[k].iloc[0] for k in by} | {"error": f"{type(e).__name__}: {e}"}], columns=[*names, "error"])

    return rows.groupBy(*by).applyInPandas(run, f"{fields}, error string")
