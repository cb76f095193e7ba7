"""Words and shingle sets of whole texts as 64-bit hashes, computed on a batch's UTF-8 bytes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)
_BASE = 0x2545F4914F6CDD1D
_ROWS_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


#: A random number for each byte; A-Z have those of a-z.
_BYTE = mix(np.arange(256, dtype=np.uint64), 99)
_BYTE[65:91] = _BYTE[97:123]


class _Powers:
    """Powers of an odd number modulo 2^64 and their inverses, as far as they were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, _ROWS_BYTES)
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, pow(_BASE, -1, 1 << 64), np.uint64)]))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts; a null row is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of other bytes than space and 9 to 13, case of A-Z aside, and where each row's runs start.

    A word's hash is a polynomial of its bytes' random numbers, taken from one running sum over all bytes.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    ends = offsets[1:] - 1
    after[ends[ends >= 0]] = True
    start, end = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    up, down = _powers.get(n)
    run = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * up)])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * _A), np.searchsorted(start, offsets)


def pieces(batches: Iterator[pa.RecordBatch], size: int = _ROWS_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes, one row at least."""
    for batch in batches:
        per = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, size // per)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        # what a batch took isn't kept for the next one
        pa.default_memory_pool().release_unused()


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """For each text, sorted distinct hashes of its ``width``-word shingles; of all its words if there are fewer."""
    ids, at = word_hashes(*utf8(column))
    h = mix(ids, width)
    for i in range(1, width):
        h = mix(h[:-1] * _A + ids[i:]) if len(h) else h
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        n = b - a
        if n >= width:
            own = np.sort(h[a : b - width + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif n:
            own = mix(ids[a : a + 1], n)
            for i in range(1, n):
                own = mix(own * _A + ids[a + i : a + i + 1])
            out.append(own)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> int:
    """One signed 64-bit number for a set: equal sets, equal numbers."""
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)
