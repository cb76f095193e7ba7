"""Near-duplicate embeddings by sorted projection passes.

In each pass every vector gets BITS random hyperplane hashes, one after the other in one number; the vectors of a label are
ordered by it, so that near vectors, which agree on most hashes, come to lie close together. Blocks of the order, each with the
WINDOW vectors before it, are compared in full, and pairs with the cosine asked for are links. Other passes have other planes.
The links of all passes give the components.

Before hashing a label's mean is taken off, or vectors with a common direction would agree on most hashes whether near or not.
A pair at the very cosine meets in a pass if it agrees on the hashes that part the label into cells of a window; from that
each label gets as many passes as find such a pair with probability RECALL, PASSES at least. This takes vectors about their mean
for spread evenly; in groups of near but unlinked vectors it can be less.

A window is bounded, so in a dense group it can't see all links. Therefore the links themselves are counted afterwards within
each component, block against block, where every pair is looked at; a link is lost only if no pass and no other vector joins
its two ends. Vectors that are equal (with their label) are one vector with a number from the start, named by a 64-bit hash, never
by an id: ids may repeat.

Passes order keys alone; a vector, as 32-bit numbers where these hold it exactly, is sent once for each pass, to its block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch

PASSES = 8
RECALL = 0.99
BITS = 48
WINDOW = 128
BLOCK = 512
COUNT_BLOCK = 1024


def _planes(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, BITS))


def projection_keys(x: np.ndarray, seed: int) -> np.ndarray:
    """The signs of BITS random projections of vectors as one number, the first plane's the highest."""
    return ((x @ _planes(x.shape[1], seed)) >= 0) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


#: Sums of components are whole multiples of 1 / SCALE, so that they don't depend on the order of rows.
SCALE = 1 << 28


def passes_for(n: int, shared: float, cosine: float, window: int, least: int, recall: float = RECALL) -> int:
    """Passes that find an isolated pair at ``cosine`` among ``n`` vectors whose mean has the squared length ``shared``."""
    bits = math.log2(max(1.0, n / window))
    spread = max(1 - shared, 1e-9)
    turned = max(-1.0, 1 - (1 - cosine) / spread)
    meets = (1 - math.acos(min(1.0, turned)) / math.pi) ** bits
    if meets >= recall:
        return least
    # as many passes as there are windows cost what comparing all pairs costs
    most = max(least, math.ceil(n / window))
    return most if meets < 1e-12 else min(most, max(least, math.ceil(math.log(1 - recall) / math.log1p(-meets))))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By label and length: how many unit vectors a batch has, and each place's sum."""
    for batch in batches:
        found: dict[tuple[str, int], list[bytes]] = {}
        for label, dim, unit in zip(*(batch.column(i).to_pylist() for i in range(3))):
            found.setdefault((label, dim), []).append(unit)
        cols: list[list] = [[], [], [], [], []]
        for (label, dim), units in found.items():
            total = np.rint(_matrix(units, dim) * SCALE).astype(np.int64).sum(axis=0)
            for c, v in zip(cols, ([label] * dim, [dim] * dim, range(dim), total.tolist(), [len(units)] * dim)):
                c += v
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["label", "dim", "at", "total", "n"])


def _stored(label, vector) -> tuple[int, bytes] | None:
    """The vector's name (equal for equal label and vector) and its bytes; None if it links with nothing."""
    if label is None or vector is None or not len(vector) or any(v is None for v in vector):
        return None
    # zeros alike
    x = np.array(vector, np.float64) + 0.0
    if not np.isfinite(x).all() or not x.any():
        return None
    with np.errstate(over="ignore", under="ignore"):
        short = x.astype(np.float32)
    name = hashlib.blake2b(f"{label}|".encode() + x.tobytes(), digest_size=8).digest()
    return int.from_bytes(name, "little", signed=True), (short if (short == x).all() else x).tobytes()


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column(1).to_pylist()
        made = [_stored(label, vector) for label, vector in zip(labels, batch.column(2).to_pylist())]
        dims = pa.array([x and len(v) for x, v in zip(made, batch.column(2))], pa.int32())
        names, units = pa.array([x and x[0] for x in made], pa.int64()), pa.array([x and x[1] for x in made], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else str(x) for x in labels], pa.string()), names, units, dims], ["id", "label", "name", "unit", "dim"])


def _keys(cosine: float, window: int, passes: int):
    """A row for each vector and pass of its label; every row has its label's count and mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64())
        for batch in batches:
            groups: dict[tuple[str, int], list[int]] = {}
            for i, g in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                groups.setdefault(g, []).append(i)
            for (label, dim), at in groups.items():
                reps, units = ([batch.column(c)[i].as_py() for i in at] for c in (0, 3))
                n, total = batch.column(4)[at[0]].as_py(), batch.column(5)[at[0]].as_py()
                mean = np.array(total, np.float64) / (SCALE * n)
                x = _matrix(units, dim) - mean if n > window else _matrix(units, dim)
                for k in range(passes_for(n, float(mean @ mean), cosine, window, passes)):
                    cols = (reps, [f"{dim}/{label}"] * len(at), [k] * len(at), projection_keys(x, k).tolist())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["rep", "label", "pass", "key"])

    return run


def _matrix(units: list[bytes], dim: int) -> np.ndarray:
    """Stored vectors at length 1, by the largest component first, so that squares neither vanish nor overflow."""
    if all(len(u) == 4 * dim for u in units):
        x = np.frombuffer(b"".join(units), np.float32).reshape(-1, dim).astype(np.float64)
    else:
        x = np.array([np.frombuffer(u, np.float32 if len(u) == 4 * dim else np.float64) for u in units], np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _near(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Whether each of x and each of y have the cosine; near the edge it is summed again without the matrix product."""
    c = x @ y.T
    for i, j in zip(*np.nonzero(np.abs(c - cosine) < 1e-12)):
        c[i, j] = float((x[i] * y[j]).sum())
    return c >= cosine


def _compare(cosine: float, window: int):
    """Rows sorted by (block, label, key), the end of the block before among them: each vector with the first it is joined to."""

    def links(rows: list[tuple]) -> tuple[list[int], list[int]]:
        u, v, start = [], [], 0
        while start < len(rows):
            end = start
            while end < len(rows) and rows[end][1] == rows[start][1]:
                end += 1
            if end - start > 1:
                x = _matrix([r[3] for r in rows[start:end]], int(rows[start][1].split("/")[1]))
                near = _near(x, x, cosine)
                if near.sum() > end - start:
                    least = np.arange(end - start)
                    while True:
                        new = np.where(near, least, end - start).min(axis=1)
                        new = new[new]
                        if (new == least).all():
                            break
                        least = new
                    for i in np.flatnonzero(least != np.arange(end - start)):
                        u.append(rows[start + int(i)][2])
                        v.append(rows[start + int(least[i])][2])
            start = end
        return u, v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            u, v = [], []
            for block, label, rep, unit in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if block != now:
                    a, b = links(rows)
                    u += a
                    v += b
                    now, rows = block, []
                rows.append((block, label, rep, unit))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        u, v = links(rows)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _count(cosine: float):
    """Rows sorted by (component, block), the block's own vectors first, then all that ask: links of each asker in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, copies, x, asks, dim = None, [], [], None, [], 0

        def answer() -> tuple[list[int], list[int]]:
            nonlocal x, asks
            if not asks:
                return [], []
            if x is None:
                x = _matrix(own, dim)
            near = _near(_matrix([a[1] for a in asks], dim), x, cosine)
            out = [a[0] for a in asks], (near @ np.array(copies, np.int64)).tolist()
            asks = []
            return out

        for batch in batches:
            ids, n = [], []
            for component, block, asking, rep, unit, k, size in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (component, block) != now:
                    a, b = answer()
                    ids += a
                    n += b
                    dim = size
                    now, own, copies, x = (component, block), [], [], None
                if asking:
                    asks.append((rep, unit))
                    if len(asks) >= 1024:
                        a, b = answer()
                        ids += a
                        n += b
                else:
                    own.append(unit)
                    copies.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["rep", "n"])
        ids, n = answer()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["rep", "n"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """A row for each vector: id, ``n_links`` (other vectors with that cosine), ``component_id`` (smallest id reachable) and ``kept``.

    Only vectors of equal, non-null label (and equal length) are compared. Vectors that are null, empty, zero, or hold null or
    non-finite components, and those without a label, have no links and are their own component. Rows that repeat a vector
    are vectors of their own and link; rows that repeat an id are vectors of their own, each in its own vector's component. Ids
    must be integers; a null id takes part, has the smallest id of its component that is not null, and is kept only if there is
    none. Extra columns are ignored, whatever their names; an empty table gives an empty one. ``passes`` is the least number of
    passes; a large label, or one whose vectors share a direction, gets more.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    rows = scratch.save(rows.mapInArrow(_prepare, "id long, label string, name long, unit binary, dim int"))
    usable = rows.filter("name is not null").groupBy(F.col("name").alias("rep"))
    classes = scratch.save(usable.agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("unit").alias("unit"), F.count(F.lit(1)).alias("copies")))
    sums = classes.select("label", "dim", "unit").mapInArrow(_sums, "label string, dim int, at int, total long, n long")
    sums = sums.groupBy("label", "dim", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    sums = sums.groupBy("label", "dim").agg(F.max("n").alias("n"), F.expr("transform(array_sort(collect_list(struct(at, total))), x -> x.total)").alias("total"))
    sums = scratch.save(sums)

    to_key = classes.select("rep", "label", "dim", "unit").join(sums, ["label", "dim"]).select("rep", "label", "dim", "unit", "n", "total")
    keyed = to_key.mapInArrow(_keys(cosine, window, passes), "rep long, label string, pass int, key long")
    # the order of all passes at once, numbered: places in a task, and after them the tasks before it
    order = ["pass", "label", "key", "rep"]
    ranged = scratch.save(scratch.save(keyed).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    placed = ranged.select(F.concat_ws("/", F.col("pass").cast("string"), "label").alias("group"), "rep", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("at"))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).selectExpr("part", "sum(n) over (order by part) - n as ahead")
    numbered = placed.join(scratch.save(sizes), "part").select("group", "rep", (F.col("ahead") + F.col("at")).alias("number"))
    own = numbered.select(F.floor(F.col("number") / block).cast("long").alias("block"), "group", "rep", "number")
    ahead = own.filter(F.pmod("number", F.lit(block)) >= block - window).withColumn("block", F.col("block") + 1)
    pairs = own.unionByName(ahead).join(classes.select("rep", "unit"), "rep")
    pairs = pairs.repartition("block").sortWithinPartitions("block", "number").select("block", "group", "rep", "unit")
    links = scratch.save(pairs.mapInArrow(_compare(cosine, window), "u long, v long"))
    scratch.drop(ranged)
    comps = connected_components(links, scratch)

    sized = comps.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / COUNT_BLOCK).cast("int").alias("blocks"))
    grouped = comps.join(sized, "component").select("component", F.col("node").alias("rep"), "blocks").join(classes.select("rep", "unit", "copies", "dim"), "rep")
    grouped = scratch.save(grouped)
    index = grouped.selectExpr("component", "cast(pmod(xxhash64(rep), blocks) as int) as block", "false as asks", "rep", "unit", "copies", "dim")
    asks = grouped.selectExpr("component", "explode(sequence(0, blocks - 1)) as block", "true as asks", "rep", "unit", "copies", "dim")
    both = index.unionByName(asks).repartition("component", "block").sortWithinPartitions("component", "block", "asks")
    counts = both.mapInArrow(_count(cosine), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))

    known = comps.select(F.col("node").alias("rep"), "component")
    of_class = classes.select("rep", "copies").join(known, "rep", "left").join(counts, "rep", "left")
    of_class = of_class.select(F.col("rep").alias("name"), F.coalesce("component", "rep").alias("class"), (F.coalesce("n", "copies") - 1).alias("n"))
    named = scratch.save(rows.select("id", "name").join(of_class, "name", "left").select("id", "class", F.coalesce("n", F.lit(0)).cast("long").alias("n")))
    least = named.filter("class is not null").groupBy("class").agg(F.min("id").alias("least"))
    out = named.join(least, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
