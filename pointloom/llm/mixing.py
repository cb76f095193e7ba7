"""Mixing sources to target weights by weighted sampling with exponential keys; DataFrame operations only.

Each source gets a target number of words. Whole epochs of the source come first; what is left of the target is filled with
the documents whose key -ln(u) / w is smallest, u uniform from a digest of the id and w the document's quality weight
(Efraimidis and Spirakis: a sample without replacement in which the weight rules the chance to come early).

The prefix sums over a source's keys don't need the source in one task: keys fall into ranges, the ranges' sums are summed up,
and only the range in which the target is reached is sorted. A key of weight w is exponential with rate w; ranges are equal in
exp(-key / 10), in which no weight from 0.1 to 1 puts more than ten times an even share into one range, so ten ranges for every
BUCKET documents keep each at some BUCKET documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
BUCKET = 4096
#: Marks of which clean prose has few.
MARKS = "!$%&#*|"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.1 to 1: the share of a text's characters that aren't MARKS, in hundredths."""
    n = F.greatest(F.length(text), F.lit(1))
    kept = F.length(F.translate(text, MARKS, ""))
    return F.coalesce(F.greatest(F.lit(10), F.floor(kept * 100 / n)), F.lit(10)) / F.lit(100.0)


def sampling_key(id_: Column, weight: Column) -> Column:
    """-ln(u) / w with u from the first 52 bits of the id's MD5, so that reruns agree."""
    u = (F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes(source, source_size)`` -> with ``weight`` (1, 2, 3 and again, by code point, null last) and ``target``.

    The sources share the sum of all sizes by weight; a target stops at MOST times the source's size and the rest is shared
    again by weight. In the order of size to weight the sources that stop are a prefix, so sums over it give the level.
    The windows run over one row for each source.
    """
    sizes = sizes.selectExpr("source", "source_size", "cast((row_number() over (order by source asc nulls last) - 1) % 3 + 1 as long) as weight")
    sizes = sizes.selectExpr("*", f"cast({MOST} * source_size as decimal(38,0)) as most", "sum(source_size) over () as total")
    order = "order by source_size / weight, source nulls last"
    sizes = sizes.selectExpr("*", f"coalesce(sum(most) over ({order} rows between unbounded preceding and 1 preceding), 0) as stopped", f"sum(weight) over ({order} rows between current row and unbounded following) as rest")
    sizes = sizes.selectExpr("*", "most * rest < (total - stopped) * weight as stops")
    first = "min_by(case when not stops then cast(total - stopped as double) / rest end, case when not stops then struct(source_size / weight, source is null, source) end) over ()"
    sizes = sizes.selectExpr("source", "source_size", "weight", "stops", "most", f"{first} as level")
    return sizes.selectExpr("source", "source_size", "weight", "case when stops then cast(most as double) else weight * level end as target")


def _bucket(key: str, buckets: str) -> str:
    return f"cast(least(floor((1 - exp(-{key} / 10)) * {buckets}), {buckets} - 1) as long)"


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """The rows (id, source, size, key, tag) and, for each source, its sums, target, epochs and the range ``edge`` in which
    what is left of the target is reached, with the words ``base`` before it; and the number of ranges."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), sampling_key(F.col(id_col), quality_weight(text)).alias("key"), F.xxhash64(id_col, source_col, text).alias("tag"))
    rows = scratch.save(rows)
    sums = scratch.save(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents")))
    targets = source_targets(sums.select("source", "source_size"))
    plan = targets.selectExpr("source", "source_size", "target", "case when source_size > 0 then cast(floor(target / source_size) as long) else 0L end as epochs")
    plan = scratch.save(plan.selectExpr("*", "target - epochs * source_size as rest"))

    n = sums.agg(F.max("documents")).first()[0] or 1
    buckets = 10 * max(1, -(-n // BUCKET))
    rows = rows.selectExpr("*", f"{_bucket('key', str(buckets))} as bucket")
    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    parts = parts.selectExpr("source", "bucket", "words", "sum(words) over (partition by source order by bucket rows between unbounded preceding and current row) - words as base")
    # the last range that begins below what is left
    at = parts.withColumnRenamed("source", "s").join(plan.select(F.col("source").alias("t"), "rest"), F.expr("s <=> t"))
    at = at.groupBy("s").agg(F.expr("coalesce(max(struct(bucket, base)) filter (where base < rest), min(struct(bucket, base)))").alias("edge")).selectExpr("s", "edge.bucket as edge", "edge.base as base")
    plan = scratch.save(plan.join(at, F.expr("source <=> s"), "left").drop("s").withColumnRenamed("source", "t"))
    return rows, plan, buckets


def _picked(edge: DataFrame, *cols: str) -> DataFrame:
    """Of the rows in their source's edge, whether each is picked."""
    edge = edge.selectExpr("*", "base + sum(size) over (partition by source order by key, id, size rows between unbounded preceding and current row) <= rest as fits")
    edge = edge.selectExpr("*", "rest - base - coalesce(sum(case when fits then size end) over (partition by source), 0L) as gap")
    edge = edge.selectExpr("*", "row_number() over (partition by source order by fits, abs(gap - size), key, id, size) as nearest")
    return edge.selectExpr(*cols, "fits or (nearest = 1 and size < 2 * gap) as picked")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """A row for each row of ``docs``: id, ``size`` (words), ``source``, ``source_size``, ``target`` and ``taken`` (words).

    A null source is a source of its own. A null, empty or blank text has size 0 and nothing is taken of it. Rows that repeat
    an id are documents of their own with the same key. A source with no words has target 0. After the documents that fit,
    one more of the last range is taken if that brings ``taken`` nearer to the target: the one that brings it nearest.
    Extra columns are ignored; an empty table gives an empty table.
    """
    rows, plan, _ = _planned(docs, id_col, text_col, source_col, scratch or Scratch(docs.sparkSession))
    rows = rows.join(plan, F.expr("source <=> t")).drop("t")
    cols = ["id", "size", "source", "source_size", "target", "epochs"]
    other = rows.filter("bucket <> edge").selectExpr(*cols, "bucket < edge as picked")
    out = other.unionByName(_picked(rows.filter("bucket = edge"), *cols))
    taken = F.expr("(epochs + case when picked then 1L else 0L end) * size")
    return out.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", taken.alias("taken"))


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, and no row else. Other columns stay as they are.

    How often a row is taken follows from its source's epochs and edge, so texts are read where they lie; only rows in the
    edge, some BUCKET for each source, are joined with what was picked there. A null source is a source of its own; rows
    without words (null, empty or blank texts) are never taken; of rows equal in id, source and text as many are taken as
    mix_sources() takes, chosen by a hash of all their columns; an empty table gives an empty one.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows, plan, buckets = _planned(docs, id_col, text_col, source_col, scratch)
    slim = rows.join(plan, F.expr("source <=> t")).drop("t").filter("bucket = edge")
    picks = _picked(slim, "tag").groupBy("tag").agg(F.count_if("picked").alias("__mix_picked"), F.count(F.lit(1)).alias("__mix_rows"))
    picks = scratch.save(picks.withColumnRenamed("tag", "__mix_pick"))

    text = F.col(text_col)
    marked = docs.filter(text.rlike(WORD)).withColumn("__mix_key", sampling_key(F.col(id_col), quality_weight(text)))
    marked = marked.withColumn("__mix_bucket", F.expr(_bucket("__mix_key", str(buckets))))
    small = plan.selectExpr("t as __mix_source", "epochs as __mix_epochs", "edge as __mix_edge")
    marked = marked.join(small, F.col(source_col).eqNullSafe(F.col("__mix_source")))
    other = marked.filter("__mix_bucket <> __mix_edge").withColumn("__mix_times", F.expr("__mix_epochs + case when __mix_bucket < __mix_edge then 1L else 0L end"))
    edge = marked.filter("__mix_bucket = __mix_edge").withColumn("__mix_tag", F.xxhash64(id_col, source_col, text_col)).join(picks, F.expr("__mix_tag = __mix_pick"))
    once = edge.filter("__mix_rows = 1").withColumn("__mix_times", F.expr("__mix_epochs + __mix_picked"))
    parts = [other, once]
    if not picks.filter("__mix_rows > 1").isEmpty():
        order = Window.partitionBy("__mix_tag").orderBy(F.xxhash64(F.to_json(F.struct(*docs.columns))))
        many = edge.filter("__mix_rows > 1").withColumn("__mix_nth", F.row_number().over(order))
        parts.append(many.withColumn("__mix_times", F.expr("__mix_epochs + case when __mix_nth <= __mix_picked then 1L else 0L end")))
    out = [p.filter("__mix_times > 0").withColumn("__mix_time", F.explode(F.sequence(F.lit(1).cast("long"), "__mix_times"))).select(*docs.columns) for p in parts]
    return reduce(DataFrame.unionByName, out)


ORACLE_SQL = """
with base as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT as size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / (coalesce(greatest(10, floor(length(translate(text, '!$%&#*|', '')) * 100.0::DOUBLE / greatest(length(text), 1))), 10) / 100.0::DOUBLE) as key
  from documents),
sums as (select source, sum(size)::BIGINT as source_size from base group by source),
weighed as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight, sum(source_size) over () as total from sums),
ordered as (select *, 3 * source_size as most,
    coalesce(sum(3 * source_size) over (order by source_size::DOUBLE / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as stopped,
    sum(weight) over (order by source_size::DOUBLE / weight, source nulls last rows between current row and unbounded following) as rest
  from weighed),
stopping as (select *, most * rest < (total - stopped) * weight as stops from ordered),
level as (select (total - stopped)::DOUBLE / rest as level from stopping where not stops order by source_size::DOUBLE / weight, source nulls last limit 1),
targets as (select source, source_size, case when stops then most::DOUBLE else weight * (select level from level) end as target from stopping),
plan as (select *, case when source_size > 0 then floor(target / source_size)::BIGINT else 0 end as epochs from targets),
counted as (select source, count(*) as n from base group by source),
buckets as (select 10 * greatest(1, ceil(max(n) / 4096.0))::BIGINT as k from counted),
placed as (select b.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size as rest,
    least(floor((1 - exp(-b.key / 10)) * k), k - 1)::BIGINT as bucket
  from base b join plan p on b.source is not distinct from p.source, buckets),
parts as (select source, bucket, any_value(rest) as rest, sum(size) as words from placed group by source, bucket),
based as (select *, sum(words) over (partition by source order by bucket rows between unbounded preceding and current row) - words as base from parts),
edges as (select source, coalesce(max(bucket) filter (where base < rest), min(bucket)) as edge from based group by source),
edged as (select p.*, e.edge, b.base from placed p join edges e on p.source is not distinct from e.source
  join based b on b.source is not distinct from e.source and b.bucket = e.edge),
fitted as (select *, base + sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and current row) <= rest as fits
  from edged where bucket = edge),
gaps as (select *, rest - base - coalesce(sum(case when fits then size end) over (partition by source), 0) as gap from fitted),
ranked as (select *, row_number() over (partition by source order by fits, abs(gap - size), key, doc_id, size) as nearest from gaps),
picks as (
  select doc_id, size, source, source_size, target, epochs, fits or (nearest = 1 and size < 2 * gap) as picked from ranked
  union all
  select doc_id, size, source, source_size, target, epochs, bucket < edge from edged where bucket <> edge)
select doc_id, size, source, source_size, target, (epochs * size + case when picked then size else 0 end)::BIGINT as taken from picks
"""
