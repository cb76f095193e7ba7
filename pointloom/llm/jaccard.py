"""N-gram Jaccard join: count-vector R-trees over cells of documents that may link.

A document is the set of its word shingles. Its shingles are hashed into groups, and the group counts are a point: GROUPS of
them, doubled as long as they hold more than FULL shingles each, for unlike long documents have like counts in few large
groups. Points of more groups are folded to fewer by adding neighbours; the tree itself is over GROUPS.
The sum over the groups of the smaller of two counts bounds the overlap of two documents from above, so a box of points
whose upper corner, or a pair whose points, can't reach the overlap asked for are passed over without a look at the sets.

One tree can't be dealt over machines without sending every query to every part. So documents go to cells first, such that
two documents that link are sure to share one. There are two kinds; both are exact, and ``cells`` chooses:

* ``groups``: a link leaves at most D shingles that only one side has, D from the smaller size. With more than D groups, some
  group has the same shingles on both sides; a cell is a group and what it holds. The number of groups goes by classes of
  sizes, and a document near the lower end of its class also takes that of the class below. Best for high thresholds, where a
  group holds many shingles, so that hardly any but near copies meet.
* ``prefix``: of n shingles in a fixed order, two documents that link share one of the first n - ceil(t n) + 1. The order is
  by how often a shingle occurs in all documents (counted in a table of fixed size), the rare ones first. Fewer rows, and
  selective only if a single shingle is; best for long shingles and lower thresholds. Prefixes are longer by one shingle in
  STEP, and two documents that link then share as many cells more, so a document that shares fewer cells than that is left
  out: those that meet by chance have few in common.

Where n - i shingles of a set stand from place i on, no larger overlap can begin there; so in a small cell, members that by
sizes and places have no partner in it are left out before any point is sent, and cells of the same members are one.

Only components are asked for, so members of a cell are first compared with one of them (linear in the cell, however many
near copies it holds). Cells whose members then are in more than one component get an R-tree over the points of each block of
members (bounded in members and in bytes). Twice: the first time each member asks for the FEW points nearest to its own, over
all its cells, which leaves near copies in one component; the second time it asks for components, each once, in which some
member's point lets a link pass. Of two components the smaller one asks. A component that is asked is compared in full, its sets
in blocks of ROOM shingles, and an ask gets one link at most as its answer. So what is passed on follows the members and the
components that lie near them, not the pairs of members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, freed_shuffles
from .shingles import mix, pieces, shingle_sets, signature
from .worker import let_go

GROUPS = 64
FULL = 8
BLOCK = 2048
BLOCK_BYTES = 1 << 22
ROOM = 1 << 20
ASKS = 4096
FEW = 3
SKETCH_BITS = 20
#: Cells of so many rows are looked through member by member before points are sent to them.
SMALL = 64
#: A set of n shingles has n // STEP more ordered cells than one common cell takes.
STEP = 16
#: Cells are counted in so many parts, one after another, so that the shuffle of one lies on disk at a time.
PARTS = 4
#: How often members of too few cells are left out.
ROUNDS = 2


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """Group counts, each below 256; groups are doubled until there are enough of them."""
    bits = GROUPS.bit_length() - 1
    place = mix(shingles, 7)
    while True:
        counts = np.bincount((place >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if len(shingles) <= FULL << bits and counts.max() < 256:
            return counts.astype(np.uint8)
        bits += 1


def to_point(size: int, counts: np.ndarray) -> bytes:
    return size.to_bytes(4, "little") + counts.tobytes()


def from_point(data) -> np.ndarray:
    """(size, group counts) of a stored point."""
    head = np.frombuffer(data, np.uint8)
    return np.concatenate([head[:4].view(np.int32), head[4:]])


def fold(counts: np.ndarray, groups: int) -> np.ndarray:
    """Vectors (the last axis) of more groups as vectors of ``groups``."""
    return counts if counts.shape[-1] == groups else counts.reshape(*counts.shape[:-1], groups, -1).sum(axis=-1)


def may_link(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two points (size, counts) allow num/den of the union in common: the sum of minima bounds the overlap."""
    groups = min(len(a), len(b)) - 1
    return bool(np.minimum(fold(a[1:], groups), fold(b[1:], groups)).sum() * (num + den) >= num * (int(a[0]) + int(b[0])))


def prefix_size(n: int, num: int, den: int) -> int:
    """Shingles of a set of n of which two sets with num/den of their union in common share at least one."""
    return n - -(-num * n // den) + 1


class RTree:
    """A packed R-tree over (size, group counts): leaves of ``fan`` points, boxes of boxes above."""

    def __init__(self, points: np.ndarray, fan: int = 16):
        order = np.lexsort((points[:, 2], points[:, 1], points[:, 0]))
        slab = max(fan, int(np.sqrt(len(points) / fan)) * fan)
        # sort-tile: slabs by size, inside a slab by the count that varies most
        for at in range(0, len(order), slab):
            part = order[at : at + slab]
            axis = 1 + int(points[part, 1:].std(axis=0).argmax())
            order[at : at + slab] = part[np.argsort(points[part, axis], kind="stable")]
        self.order, self.fan, self.points = order, fan, points[order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        low, high = self.points[:, 0], self.points
        while len(high) > 1:
            starts = np.arange(0, len(high), fan)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts, axis=0)
            self.levels.append((low, high))

    def search(self, q: np.ndarray, num: int, den: int) -> np.ndarray:
        """Positions of all points whose bound allows num/den of the union with q in common."""
        at = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.points))
        for k in range(len(self.levels) - 1, -1, -1):
            low, high = self.levels[k]
            at = at[self._may(q, low[at], high[at], num, den)]
            at = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
            at = at[at < (len(self.levels[k - 1][0]) if k else len(self.points))]
        at = at[self._may(q, self.points[at, 0], self.points[at], num, den)]
        return self.order[at]

    @staticmethod
    def _may(q: np.ndarray, least: np.ndarray, high: np.ndarray, num: int, den: int) -> np.ndarray:
        # overlap i of sizes a and b reaches num/den of the union iff i * (num + den) >= num * (a + b)
        return np.minimum(q[1:], high[:, 1:]).sum(axis=1) * (num + den) >= num * (q[0] + least)


def _packed(counts: np.ndarray) -> bytes:
    """2^14 counters in the fewest bytes each that hold the largest."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) >> 14}").astype(np.int64)


def _sketch(width: int, bits: int):
    """How often the hashes of all shingles fall into each of 2^bits counters, as blocks of 2^14 counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total = np.zeros(1 << bits, np.int64)
        for batch in pieces(batches):
            own = np.concatenate([np.empty(0, np.uint64), *shingle_sets(batch.column(0), width)])
            total += np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(total)
        if len(at):
            step = 1 << 14
            starts = np.unique(at >> 14)
            rows = [(int(k), _packed(total[k * step : (k + 1) * step])) for k in starts]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], ["part", "counts"])

    return run


def _add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = sum(_unpacked(x.as_py()) for x in table.column("counts"))
    return pa.table({"part": [key[0].as_py()], "counts": [_packed(total)]})


def shingle_levels(docs: DataFrame, text: str, width: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """For each counter, how many doublings it lies above the mean of all: 0 for all that aren't frequent.

    What reaches the driver has 2^bits counters, whatever the size of the corpus.
    """
    parts = docs.select(text).mapInArrow(_sketch(width, bits), "part long, counts binary")
    total = np.zeros(1 << bits, np.float64)
    for row in parts.groupBy("part").applyInArrow(_add, "part long, counts binary").collect():
        total[row["part"] << 14 : (row["part"] + 1) << 14] = _unpacked(row["counts"])
    mean = max(4.0, total.mean())
    return np.maximum(0, np.floor(np.log2(np.maximum(total, 1) / mean))).astype(np.uint8)


class SizeClasses:
    """Classes of set sizes and the number of groups in each, for links of num/den of the union."""

    def __init__(self, num: int, den: int, ratio: float = 1.5):
        self.num, self.den, self.ratio = num, den, ratio
        self.low, self.spread, self.groups = [1], [], []

    def _reach(self, n: int) -> None:
        while self.low[-1] <= n:
            low, above = self.low[-1], max(self.low[-1] + 1, int(self.low[-1] * self.ratio))
            spread = (above - 1) * (self.den - self.num) // self.num
            groups = spread + 1
            # room for groups that are empty by chance, so that few documents need cells for these
            for _ in range(30 if spread else 0):
                empty = groups * np.exp(-low / groups)
                if groups >= spread + 1 + empty + 4 * empty**0.5:
                    break
                groups += max(1, int(spread + 1 + empty + 4 * empty**0.5 - groups))
            self.low.append(above)
            self.spread.append(spread)
            self.groups.append(groups)

    def cells(self, shingles: np.ndarray) -> np.ndarray:
        """Hashes of (class, group, what the group holds). Empty groups make a cell only for sets that have so many of them
        that two such sets might have nothing else in common."""
        n = len(shingles)
        self._reach(n)
        k = int(np.searchsorted(self.low, n, "right")) - 1
        value, place, out = mix(shingles, 13), mix(shingles, 11), []
        for i in range(k, -1, -1):
            if i < k and self.num * n > self.den * (self.low[i + 1] - 1):
                break
            groups = self.groups[i]
            at = (place % np.uint64(groups)).astype(np.int64)
            held = np.zeros(groups, np.uint64)
            np.add.at(held, at, value)
            keys = mix(held ^ mix(np.arange(groups, dtype=np.uint64) + np.uint64(i << 32)))
            full = np.bincount(at, minlength=groups) > 0
            out.append(keys if groups - full.sum() >= groups - self.spread[i] else keys[full])
        return np.concatenate(out)


def prefix_cells(shingles: np.ndarray, num: int, den: int, level: np.ndarray) -> np.ndarray:
    k = prefix_size(len(shingles), num, den) + len(shingles) // STEP
    bits = len(level).bit_length() - 1
    order = level[(shingles >> np.uint64(64 - bits)).astype(np.int64)] | mix(shingles, 3) >> np.uint64(6)
    return np.sort(np.partition(order, k - 1)[:k] if k < len(order) else order)


def least_common(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Ordered cells that a set of n shares at least with any set that links with it: such a set is no smaller than num/den of
    it, and of the prefixes of both, the shorter in cells more holds as many common shingles, and one."""
    return -(-num * n // den) // STEP + 1


def reach(n: np.ndarray, at: np.ndarray, num: int, den: int) -> np.ndarray:
    """The largest set that can link with a set of n whose first common shingle, in the fixed order, stands at position ``at``:
    no more than the n - at shingles from there on are common."""
    return (n - at) * (num + den) // num - n


def _features(width: int, num: int, den: int, levels):
    """(row's id, set size, signature, cells, point); a set met before in the same task has no cells again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        known, classes = set(), SizeClasses(num, den)
        level = levels.value.astype(np.uint64) << np.uint64(58) if levels else None
        for batch in pieces(batches):
            n, sig, keys, points = [], [], [], []
            for own in shingle_sets(batch.column(1), width):
                n.append(len(own))
                points.append(to_point(len(own), count_vector(own)) if len(own) else None)
                sig.append(signature(own) if len(own) else None)
                if not len(own) or sig[-1] in known:
                    keys.append(None)
                    continue
                if len(known) < 1 << 18:
                    known.add(sig[-1])
                keys.append((classes.cells(own) if level is None else prefix_cells(own, num, den, level)).view(np.int64))
            cols = [pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(points, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], ["id", "text_hash", "n", "sig", "keys", "point"])

    return run


def bitmap(hashes: DataFrame, most_bits: int = 27) -> np.ndarray:
    """A bit for each 64-bit hash in column ``h``, ten bits a hash, 2^most_bits at most (16 MB): what is sent to all tasks has
    this bound. More hashes only make the test below let more rows pass."""
    n = hashes.count()
    bits = min(most_bits, max(16, (10 * n).bit_length()))
    word, bit = F.shiftrightunsigned(F.col("h"), 64 - bits + 6), F.shiftrightunsigned(F.col("h"), 64 - bits).bitwiseAND(63).cast("int")
    rows = hashes.select(word.alias("word"), bit.alias("b")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
    table = rows.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint64)


def may_hold(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = np.uint64(len(table).bit_length() - 1 + 6)
    at = hashes.view(np.uint64) >> (np.uint64(64) - bits)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _kept_cells(table, num: int, den: int, ordered: bool):
    """(cell, sig, bit, n, reach) for each cell that the table may hold with this class of sizes in the highest bits;
    ``ordered`` cells stand in the order of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            lists = batch.column(1)
            keys = lists.flatten().to_numpy(zero_copy_only=False)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(lists)), lengths)
            at = np.arange(len(keys)) - np.repeat(np.cumsum(lengths) - lengths, lengths) if ordered else np.zeros(len(keys), np.int64)
            sigs, bits, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            size = np.log2(bits.view(np.uint64).astype(np.float64)).astype(np.int64) << 58
            n = sizes[row]
            # halves are swapped, for the highest bits of ordered cells are their level, much the same for all
            swapped = (keys.view(np.uint64) << np.uint64(32) | keys.view(np.uint64) >> np.uint64(32)).view(np.int64)
            keep = may_hold(table.value, swapped ^ size[row])
            if ordered:
                keep &= np.bincount(row[keep], minlength=len(lists))[row] >= least_common(n, num, den)
                # any of the common cells that are counted may stand here, not the first only
                at = np.maximum(at - n // STEP, 0)
            row, at, n = row[keep], at[keep], n[keep]
            cols = [keys[keep], sigs[row], bits[row], n, reach(n, at, num, den)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["cell", "sig", "bit", "n", "reach"])

    return run


def _sets(width: int, wanted, sigs):
    """Sets of the rows whose hash of id and text and whose signature may be wanted, each signature once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(wanted.value, batch.column(0).to_numpy(zero_copy_only=False))))
            for part in pieces(iter([batch])):
                own = [x for x in shingle_sets(part.column(1), width) if len(x)]
                names = np.array([signature(x) for x in own], np.int64)
                keep = []
                for i in np.flatnonzero(may_hold(sigs.value, names)).tolist():
                    if names[i] not in seen:
                        seen.add(names[i])
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(names[keep], pa.int64()), pa.array([own[i].tobytes() for i in keep], pa.binary())], ["sig", "shingles"])

    return run


def _named_in(table, wanted: bool):
    """Rows whose last column, a hash, the table may hold, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(may_hold(table.value, names) == wanted, pa.bool_()))

    return run


def _bound(num: int, den: int):
    """Of pairs with both points, those whose sum of minima allows a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = [may_link(from_point(p.as_buffer()), from_point(q.as_buffer()), num, den) for p, q in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(may, pa.bool_()))

    return run


def _answer(num: int, den: int):
    """Rows sorted by (group, block, salt), the sets that are asked first, then the sets that ask: for each ask one set that
    links with it, if there is any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sets, index = None, [], [], None
        for batch in batches:
            u, v = [], []
            keys = zip(*(batch.column(i).to_pylist() for i in range(5)))
            for (group, block, salt, asks, sig), data in zip(keys, batch.column(5)):
                if (group, block, salt) != now:
                    now, names, sets, index = (group, block, salt), [], [], None
                own = np.frombuffer(data.as_buffer(), np.uint64)
                if not asks:
                    names.append(sig)
                    # the batch's memory isn't held
                    sets.append(own.copy())
                    continue
                if not names:
                    continue
                if index is None:
                    sizes = np.array([len(x) for x in sets])
                    held, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                    order = np.argsort(held, kind="stable")
                    index, sets = (held[order], owner[order], sizes), []
                held, owner, sizes = index
                low, high = np.searchsorted(held, own, "left"), np.searchsorted(held, own, "right")
                count = high - low
                at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                common = np.bincount(owner[at], minlength=len(names))
                best = int(np.argmax(common * (num + den) - num * (sizes + len(own))))
                if common[best] * (num + den) >= num * (int(sizes[best]) + len(own)):
                    u.append(sig)
                    v.append(names[best])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _near(num: int, den: int, wide: bool):
    """Rows sorted by (cell, block, guest): of a block's own members, each asks for what others of it may link with; guests ask
    only. With ``wide`` the answers are all components, else the nearest member: (asker, answer, distance)."""

    def answers(rows: list[tuple], points: list[np.ndarray], own: int, start: int) -> Iterator[tuple[int, int, int]]:
        rank = [(r[2], r[1]) for r in rows]
        if own == 0 or max(rank[:own]) == min(rank):
            return
        coarse = np.array([np.concatenate([p[:1], fold(p[1:], GROUPS)]) for p in points], np.int64)
        ranked = {k: i for i, k in enumerate(sorted(set(rank)))}
        order = np.array([ranked[k] for k in rank])
        comps = np.array([r[1] for r in rows[:own]])
        tree = RTree(coarse[:own])
        top = order[:own].max()
        for i in start + np.flatnonzero(order[start:] < top):
            found = tree.search(coarse[i], num, den)
            found = found[order[found] > order[i]]
            if not len(found):
                continue
            apart = np.abs(coarse[found] - coarse[i]).sum(axis=1)
            done: set[int] = set()
            for k in np.argsort(apart, kind="stable"):
                j = int(found[k])
                if comps[j] in done or not may_link(points[i], points[j], num, den):
                    continue
                done.add(int(comps[j]))
                if not wide:
                    yield rows[i][0], rows[j][0], int(apart[k])
                    break
                yield rows[i][0], int(comps[j]), 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, points, own, start = None, [], [], 0, 0
        out: list[tuple[int, int, int]] = []

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "g", "apart"])

        def answered() -> Iterator[pa.RecordBatch]:
            for found in answers(rows, points, own, start):
                out.append(found)
                if len(out) >= 1 << 15:
                    yield batch_of()

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(6)))
            for (cell, block, guest, sig, comp, size), data in zip(keys, batch.column(6)):
                if (cell, block) != now:
                    yield from answered()
                    now, rows, points, own, start = (cell, block), [], [], 0, 0
                elif len(rows) >= own + BLOCK:
                    # guests are answered in groups
                    yield from answered()
                    rows, points, start = rows[:own], points[:own], own
                rows.append((sig, comp, size))
                points.append(from_point(data.as_buffer()))
                own += not guest
            yield batch_of()
        yield from answered()
        yield batch_of()

    return run


def _classes(docs: DataFrame, width: int, num: int, den: int, cells: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``docs(id, text)`` -> a row for each of them (id, n, sig, text_hash) and the components (node, component) of the sigs."""
    spark = docs.sparkSession
    if cells not in ("groups", "prefix"):
        raise ValueError(f"cells must be groups or prefix, not {cells}")
    levels = spark.sparkContext.broadcast(shingle_levels(docs, "text", width)) if cells == "prefix" else None
    rows = docs.select("id", "text", F.xxhash64("text").alias("text_hash"))
    rows = scratch.save(rows.mapInArrow(_features(width, num, den, levels), "id long, text_hash long, n long, sig long, keys array<long>, point binary"))

    # Sizes of sets that link are in one class or in neighbouring ones. A cell counts if two different sets of it may be: with
    # as many rows as classes, two of these must be neighbours. A hot cell is one row of each task here, and then a skewed
    # join that Spark splits.
    near = f"ln({max(1.25, 1.001 * den / num)})"
    sized = rows.filter("keys is not null").selectExpr("sig", "keys", f"shiftleft(1L, cast(least(63, floor(ln(n) / {near})) as int)) as bit", "n")
    counted = sized.select(F.explode("keys").alias("cell"), "sig", "bit")
    # the classes whose members stay: those with a neighbour, or all that there are
    live = "case when rows > bit_count(bits) then bits else bits & (shiftleft(bits, 1) | shiftrightunsigned(bits, 1)) end"
    parts = []
    for part in range(PARTS):
        ends = counted.filter(f"pmod(cell, {PARTS}) = {part}").groupBy("cell").agg(F.min("sig").alias("first"), F.max("sig").alias("last"), F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("rows"))
        ends = ends.filter("first <> last and (rows > bit_count(bits) or bits & shiftleft(bits, 1) <> 0)")
        parts.append(scratch.save(ends.selectExpr("cell", "first", f"{live} as live", f"rows <= {SMALL} as small")))
    ends = reduce(DataFrame.unionByName, parts)
    classes = ends.select(F.expr("explode(filter(sequence(0, 63), c -> live & shiftleft(1L, c) <> 0))").alias("c"), "cell")
    table = spark.sparkContext.broadcast(bitmap(classes.select(F.expr("(shiftleft(cell, 32) | shiftrightunsigned(cell, 32)) ^ shiftleft(cast(c as long), 58)").alias("h"))))
    kept = sized.mapInArrow(_kept_cells(table, num, den, cells == "prefix"), "cell long, sig long, bit long, n long, reach long")
    kept = scratch.save(kept.join(ends, "cell").filter("live & bit <> 0").select("cell", "sig", "first", "n", "reach", "small"))
    # the lists of cells are most of this table, and aren't read again
    lean = scratch.save(rows.drop("keys"))
    scratch.drop(rows, *parts)
    rows = lean
    # Of a small cell stays who has a partner there by sizes and places; cells of the same members are one.
    small = kept.filter("small").groupBy("cell").agg(F.collect_set(F.struct("sig", "n", "reach")).alias("m"))
    partners = "filter(m, a -> exists(m, b -> b.sig <> a.sig and b.n <= a.reach and a.n <= b.reach))"
    small = small.selectExpr(f"array_sort(array_distinct(transform({partners}, a -> struct(a.sig as sig, a.n as n)))) as sigs").filter("size(sigs) > 1")
    small = small.groupBy("sigs").agg(F.count(F.lit(1)).alias("k")).selectExpr("xxhash64(sigs.sig) as cell", "inline(sigs)", "sigs[0].sig as first", "k")
    shared = scratch.save(kept.filter("not small").select("cell", "sig", "n", "first").distinct().withColumn("k", F.lit(1).cast("long")).unionByName(small))
    scratch.drop(kept)
    for _ in range(ROUNDS if cells == "prefix" else 0):
        # who is in fewer cells than a link takes goes, and then cells of one member
        enough = shared.groupBy("sig").agg(F.sum("k").alias("k"), F.max("n").alias("n")).filter(f"k >= ({num} * n + {den - 1}) div {den} div {STEP} + 1").select("sig")
        stay = scratch.save(shared.drop("first").join(enough, "sig", "left_semi"))
        firsts = stay.groupBy("cell").agg(F.min("sig").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("cell", "first")
        fewer = scratch.save(stay.join(firsts, "cell"))
        scratch.drop(shared, stay)
        shared = fewer
    points = rows.filter("point is not null").select("sig", "point").join(shared.select("sig").distinct(), "sig", "left_semi")
    points = scratch.save(points.groupBy("sig").agg(F.first("point").alias("point")))
    weights = points.select("sig", F.length("point").alias("bytes"))

    def linked(asks: DataFrame, members: DataFrame) -> DataFrame:
        """A link at most for each of ``asks(u, g)``, with one of the ``members(g, sig)``. Only these sets are read again."""
        sigs = scratch.save(asks.select(F.col("u").alias("sig")).union(members.select("sig")).distinct())
        ids = rows.filter("n > 0").join(sigs, "sig", "left_semi").groupBy("sig").agg(F.min(F.xxhash64("id", "text_hash")).alias("h"))
        wanted = spark.sparkContext.broadcast(bitmap(ids.select("h")))
        names = spark.sparkContext.broadcast(bitmap(sigs.select(F.col("sig").alias("h"))))
        again = docs.select(F.xxhash64("id", F.xxhash64("text")).alias("h"), "text")
        sets = scratch.save(again.mapInArrow(_sets(width, wanted, names), "sig long, shingles binary"))
        salts = asks.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / ASKS).cast("int").alias("salts"))
        blocks = members.join(weights, "sig").groupBy("g").agg(F.ceil(F.sum("bytes") * FULL / ROOM).cast("int").alias("blocks"))
        sized = salts.join(blocks, "g")
        index = members.join(sized, "g").selectExpr("g", "cast(pmod(xxhash64(sig), blocks) as int) as block", "explode(sequence(0, salts - 1)) as salt", "false as asks", "sig")
        asking = asks.join(sized, "g").selectExpr("g", "explode(sequence(0, blocks - 1)) as block", "cast(pmod(xxhash64(u), salts) as int) as salt", "true as asks", "u as sig")
        both = index.unionByName(asking).join(sets, "sig").select("g", "block", "salt", "asks", "sig", "shingles")
        both = both.repartition("g", "block", "salt").sortWithinPartitions("g", "block", "salt", "asks")
        found = scratch.save(both.mapInArrow(_answer(num, den), "u long, v long"))
        scratch.drop(sigs, sets)
        return found

    votes = shared.filter("sig <> first").groupBy("sig", "first").agg(F.sum("k").alias("k"))
    star = votes.groupBy("sig").agg(F.max_by("first", F.struct("k", "first")).alias("g"))
    star = star.join(points, "sig").join(points.select(F.col("sig").alias("g"), F.col("point").alias("of_g")), "g")
    star = scratch.save(star.select(F.col("sig").alias("u"), "g", "point", "of_g").mapInArrow(_bound(num, den), "u long, g long"))
    links = linked(star, star.select("g").distinct().select("g", F.col("g").alias("sig")))
    comps = connected_components(links, scratch)
    for wide in (False, True):
        sized = comps.join(comps.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component")
        known = weights.join(sized.select(F.col("node").alias("sig"), "component", "size"), "sig", "left")
        known = scratch.save(known.select("sig", "bytes", F.coalesce("component", "sig").alias("comp"), F.coalesce("size", F.lit(1)).alias("size")))
        named = scratch.save(shared.join(known, "sig").select("cell", "sig", "bytes", "comp", "size"))
        of_cell = named.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("size", "comp")).alias("top"), F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
        of_cell = of_cell.filter("lo <> hi").selectExpr("cell", "top.size as top_size", "top.comp as top_comp", "blocks")
        open_ = scratch.save(named.join(of_cell, "cell").selectExpr("cell", "sig", "comp", "size", "cast(pmod(xxhash64(sig), blocks) as int) as block", "blocks", "size = top_size and comp = top_comp as top"))
        if open_.isEmpty():
            scratch.drop(known, named, open_)
            break
        own = open_.selectExpr("cell", "block", "false as guest", "sig", "comp", "size")
        guests = open_.filter("blocks > 1 and not top").selectExpr("cell", "block as home", "explode(sequence(0, blocks - 1)) as block", "true as guest", "sig", "comp", "size").filter("block <> home").drop("home")
        both = own.unionByName(guests).join(points, "sig").select("cell", "block", "guest", "sig", "comp", "size", "point")
        both = both.repartition("cell", "block").sortWithinPartitions("cell", "block", "guest")
        asks = both.mapInArrow(_near(num, den, wide), "u long, g long, apart long")
        if wide:
            asks = scratch.save(asks.select("u", "g").distinct())
            members = known.select(F.col("comp").alias("g"), "sig").join(asks.select("g").distinct(), "g", "left_semi")
        else:
            asks = asks.groupBy("u", "g").agg(F.min("apart").alias("apart"))
            asks = asks.selectExpr("u", "g", "row_number() over (partition by u order by apart, g) as nth").filter(f"nth <= {FEW}")
            asks = scratch.save(asks.select("u", "g"))
            members = asks.select("g").distinct().select("g", F.col("g").alias("sig"))
        more = linked(asks, members)
        if not more.isEmpty():
            links = links.unionByName(more)
            comps = connected_components(links, scratch)
        scratch.drop(known, named, open_, asks)
    scratch.drop(points, shared, star)
    return rows.select("id", "text_hash", "n", "sig"), comps


def _named(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, cells: str, scratch: Scratch) -> DataFrame:
    """(id, text_hash, n, class): rows of one class are linked; the class of a row without words is null."""
    rows, comps = _classes(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), width, num, den, cells, scratch)
    known = comps.select(F.col("node").alias("sig"), "component")
    return rows.join(known, "sig", "left").select("id", "text_hash", "n", F.coalesce("component", "sig").alias("class"))


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 90, den: int = 100, cells: str = "groups", scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of ``docs``: its id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Two documents link when ``den * |A & B| >= num * |A | B|`` of their sets of ``width``-word shingles (see shingles.py:
    A-Z in lower case; a text with fewer words is one shingle). Documents with a null, empty or blank text have size 0 and
    are their own component. Equal sets are one class from the start, in any number. Rows that repeat an id are documents of
    their own, each in the component of its text; a null id takes part and has the smallest id that is not null, or null.
    Texts of any length are taken whole; an empty table gives an empty one. Other columns are ignored, whatever their names.
    Sets are compared by 64-bit hashes of their shingles, and a set is named by 64 bits, so with N different sets a false
    merge is to be expected N^2 / 2^65 times.
    """
    with freed_shuffles(docs.sparkSession):
        named = _named(docs, id_col, text_col, width, num, den, cells, scratch or Scratch(docs.sparkSession))
    least = named.filter("class is not null").groupBy("class").agg(F.min("id").alias("least"))
    out = named.join(least, "class", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, cells: str = "prefix", scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs``, one of each component of linked documents: that with the smallest id, a null id last, and of rows
    with that id the text with the smallest hash.

    Rows that repeat an id and a text are copies; rows that repeat only an id are documents of their own. A text without words
    (null, empty or blank) is never a copy. Texts are taken whole; an empty table gives an empty one; other columns stay as
    they are, whatever their names.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    with freed_shuffles(docs.sparkSession):
        return _without_similar(docs, id_col, text_col, width, num, den, cells, scratch)


def _without_similar(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, cells: str, scratch: Scratch) -> DataFrame:
    rows = scratch.save(_named(docs, id_col, text_col, width, num, den, cells, scratch).filter("class is not null"))
    first = rows.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("no"), F.col("id"), F.col("text_hash"))).alias("f"))
    first = first.selectExpr("class", "f.id as first_id", "f.text_hash as first_hash")
    marked = rows.join(first, "class").selectExpr("id", "text_hash", "id <=> first_id and text_hash = first_hash as stays")
    marked = marked.groupBy("id", "text_hash", "stays").agg(F.count(F.lit(1)).alias("copies"))
    # rows that stay as they are need no mark
    marked = scratch.save(marked.filter("not stays or copies > 1").selectExpr("id as __id", "text_hash as __hash", "stays as __stays"))
    on = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash"))
    hashed = docs.withColumn("__text_hash", F.xxhash64(text_col))
    # most texts have no mark, and those that can't have one aren't shuffled
    of = docs.sparkSession.sparkContext.broadcast(bitmap(marked.select(F.xxhash64(F.col("__id").cast("long"), "__hash").alias("h"))))
    named = hashed.withColumn("__name", F.xxhash64(F.col(id_col).cast("long"), "__text_hash"))
    plain = named.mapInArrow(_named_in(of, False), named.schema).select(*docs.columns)
    hashed = named.mapInArrow(_named_in(of, True), named.schema).drop("__name")
    out = plain.unionByName(hashed.join(marked, on, "left_anti").select(*docs.columns))
    twice = marked.filter("__stays")
    if twice.isEmpty():
        return out
    return out.unionByName(hashed.join(twice, on, "left_semi").dropDuplicates([id_col, text_col]).select(*docs.columns))
