"""Sources and sinks: text-first CSV, JSON lines, Parquet by stage and match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import columns as C
from ..operators.relational import whole_copies


def read_text_csv(spark: SparkSession, paths: str | list[str], columns: T.StructType, encoding: str = "ISO-8859-1") -> DataFrame:
    """All columns as stripped text, with the file's name and a number that follows the file's order.

    Columns are taken by position: every file must have them all in this order.
    """
    raw = spark.read.schema(columns).option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"').option("enforceSchema", True).option("nullValue", "\u0000").csv(paths)
    text = [F.coalesce(C.stripped(F.col(f"`{c}`")), F.lit("")).alias(c) for c in columns.names]
    return raw.select(*text, F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))


def file_patterns(folder: str, kinds: tuple[str, ...] = ("m", "w"), decades: tuple[str, ...] = ("to-2009", "2010s", "2020s")) -> list[str]:
    """Paths of the point files: one for each kind and decade."""
    return [f"{folder}/charting-{k}-points-{d}.csv" for k in kinds for d in decades]


def read_matches(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The match list, both files as one, with gender (from the file's name), year, date and best_of; null where malformed."""
    rows = read_text_csv(spark, paths, schema.MATCHES)
    gender = F.regexp_extract("file", r"charting-([mw])-", 1)
    return rows.select(
        *schema.MATCHES.names, F.when(gender != "", gender).alias("gender"), F.substring("Date", 1, 4).try_cast("int").alias("year"),
        F.try_to_timestamp("Date", F.lit("yyyyMMdd")).cast("date").alias("date"), F.col("Best of").try_cast("int").alias("best_of"),
    )


def read_points(spark: SparkSession, paths: list[str], match_ids: DataFrame | None = None, dedupe: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Points, typed, of all or some matches; matches entered twice reduced to their best copy, with the count of rows gone."""
    rows = read_text_csv(spark, paths, schema.POINTS)
    if match_ids is not None:
        rows = rows.join(match_ids.select("match_id").distinct(), "match_id", "left_semi")
    number = lambda c: F.col(f"`{c}`").try_cast("int").alias(c)
    cols = [number(c) if c in schema.POINT_INTEGERS else F.when(F.col(c) == "True", True).when(F.col(c) == "False", False).alias(c) if c == "TbSet" else F.col(f"`{c}`") for c in schema.POINTS.names]
    rows = rows.select(*cols, "line")
    if not dedupe:
        return rows, None
    placeholder = F.col("1st").isin("S", "R", "P", "Q").cast("int")
    chars = F.length("1st") + F.length("2nd")
    kept, gone = whole_copies(rows, "match_id", "Pt", "line", placeholder, chars)
    return kept, gone


def read_manifest(spark: SparkSession, path: str, columns: T.StructType, round_names: dict[str, str]) -> DataFrame:
    """A video manifest with tidy text, rounds under one name and the key of both surnames."""
    rows = read_text_csv(spark, path, columns, "UTF-8")
    one, two = C.fold_name(F.col("player1")), C.fold_name(F.col("player2"))
    round_ = F.upper(F.col("round"))
    return rows.withColumn("round", F.coalesce(C.lookup(round_, round_names), round_)).withColumn("draw", F.lower("draw")).withColumn("key", C.pair_key(C.surname(one), C.surname(two)))


def read_json_lines(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    return spark.read.schema(columns).json(path)


def read_stage(spark: SparkSession, root: str, stage: str, *columns: str) -> DataFrame:
    """Some columns of a stage's Parquet, partitioned by match."""
    df = spark.read.parquet(f"{root}/{stage}")
    return df.select(*columns) if columns else df


def write_stage(df: DataFrame, root: str, stage: str, match: str = "video_id") -> None:
    """Replaces just the partitions of the matches that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(match).parquet(f"{root}/{stage}")


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A CSV with header; ``one_file`` only for reports, whose rows one task can hold."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """The report's tables, a file each."""
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}", one_file=True)


def markdown(df: DataFrame, limit: int = 1000, digits: int = 3) -> str:
    """A small result as a table in Markdown."""
    spell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = [df.columns, ["---"] * len(df.columns), *[[spell(v) for v in r] for r in df.limit(limit).collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a path with their sizes: what to copy is an anti join of two listings."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))


def to_copy(here: DataFrame, there: DataFrame, name: Column) -> DataFrame:
    """Files of ``here`` that aren't ``there`` with the same size."""
    return here.withColumn("name", name).join(there.withColumn("name", name).select("name", "bytes"), ["name", "bytes"], "left_anti")


def verified(probes: DataFrame) -> DataFrame:
    """Files whose duration is within 1% of the one announced and that decoded without an error."""
    near = F.abs(F.col("duration_s") - F.col("announced_s")) <= 0.01 * F.col("announced_s")
    return probes.withColumn("ok", F.coalesce(near & (F.col("errors") == 0), F.lit(False)))
