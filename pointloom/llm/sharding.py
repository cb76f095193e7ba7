"""Shards of near equal bytes by histogram sort; DataFrame operations only.

Rows are ordered by (hash of the text, hash of the id): equal texts lie together. The cuts between shards are found without
a sort. Each round counts the exact bytes below evenly spaced probes inside every range that still holds a cut, and keeps the
part that the cut falls into; a cut is settled when a probe lies within TOLERANCE of a shard from its target, else the next
round probes that part alone. A cut that the hash of the text can't settle lies in a group of equal texts too large for the
tolerance and is refined by the hash of the id. Only sums by probe reach the driver, at most 2^BITS + 1 for each open cut.
With the splitters known, the rows move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

OVERHEAD = 16
BITS = 8
TOLERANCE = 0.01
CELL = 65536


def _unsigned(x: Column) -> Column:
    """A hash as a number from 0 to 2^62 - 1, in a long."""
    return F.shiftrightunsigned(x, 2)


def _splitters(rows: DataFrame, shards: int, total: int, tolerance: float) -> list[tuple[int, int]]:
    """Keys (a, b): shard k starts at the k-th. Rows have ``a`` and ``b`` below 2^62 and ``size``."""
    width, cuts = 62, [(0, 0)] * (shards + 1)
    # range of a cut still open: (level, fixed a or None, start, bits left, bytes below its start)
    open_ = {k: (None, 0, width, 0) for k in range(1, shards)}
    while open_ and total:
        ranges = sorted({v for v in open_.values()}, key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
        tests = None
        for i, (a, start, bits, _) in enumerate(ranges):
            key = "a" if a is None else "b"
            held = (F.col("a") == F.lit(a)) if a is not None else F.lit(True)
            held = held & (F.shiftright(key, bits) == F.lit(start >> bits))
            step = max(0, bits - BITS)
            probe = F.struct(F.lit(i).alias("range"), F.shiftright(F.col(key) - F.lit(start), step).alias("bin"), F.col(key).alias("key"))
            one = F.when(held, probe)
            tests = [one] if tests is None else [*tests, one]
        found = rows.select("size", F.explode(F.array_compact(F.array(*tests))).alias("at")) if len(tests) > 1 else rows.select("size", tests[0].alias("at")).filter("at is not null")
        sums: dict[int, dict[int, tuple]] = {}
        made = found.select("size", "at.*").groupBy("range", "bin").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        for r in made.collect():
            sums.setdefault(r["range"], {})[r["bin"]] = (r["bytes"], r["n"], r["lo"], r["hi"])
        place = {v: i for i, v in enumerate(ranges)}
        for k, v in list(open_.items()):
            a, start, bits, below = v
            target, step = total * k / shards, max(0, bits - BITS)
            at = below
            for b in sorted(sums.get(place[v], {})):
                more, n, lo, hi = sums[place[v]][b]
                if at + more < target:
                    at += more
                    continue
                low, high = start + (b << step), start + ((b + 1) << step)
                near, key = min((abs(target - at), low), (abs(at + more - target), high))
                if near <= tolerance * total / shards or n == 1 or (lo == hi and a is not None):
                    cuts[k] = (key, 0) if a is None else (a, key)
                    del open_[k]
                elif lo == hi:
                    open_[k] = (lo, 0, width, at)
                else:
                    open_[k] = (a, low, step, at)
                break
            else:
                cuts[k] = (1 << width, 0)
                del open_[k]
    return cuts[1:shards]


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, scratch: Scratch | None = None) -> DataFrame:
    """A row for each row of ``docs``: id, ``size`` (UTF-8 bytes of the text and 16), ``text_crc32``, ``law`` ('bytes'),
    ``shard`` from 0, ``slot`` (gapless from 0 in its shard) and ``grown_shard`` (null: that law is about keys).

    A null text has no bytes and the CRC of none. Shards differ by the tolerance and by what can't be split: rows that repeat
    both id and text have one key and stay together, and a single document is never cut. Equal texts stay together unless
    their group is larger than the tolerance. Empty tables give empty tables; extra columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"),
        _unsigned(F.xxhash64(text)).alias("a"), _unsigned(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("b"),
    )
    rows = scratch.save(rows)
    total, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    cuts = _splitters(rows, shards, total or 0, tolerance)
    after = F.lit(0)
    for a, b in cuts:
        after = after + ((F.col("a") > F.lit(a)) | ((F.col("a") == F.lit(a)) & (F.col("b") >= F.lit(b)))).cast("int")
    cells = max(1, -(-n // (shards * CELL)))
    rows = rows.select("id", "size", "text_crc32", after.cast("int").alias("shard"), F.pmod(F.col("b"), F.lit(cells)).cast("int").alias("cell"), "a", "b")
    counts = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    first = counts.selectExpr("shard as s", "cell as c", "sum(n) over (partition by shard order by cell) - n as base")
    placed = rows.selectExpr("*", "row_number() over (partition by shard, cell order by a, b, id) - 1 as within")
    placed = placed.join(first, (F.col("shard") == F.col("s")) & (F.col("cell") == F.col("c")))
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
