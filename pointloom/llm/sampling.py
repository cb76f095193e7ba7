"""A bounded sample of rows for fitting: by a hash of the id, exact over all of its 64 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_limit(rows: int, most: int) -> int:
    """The largest 64-bit hash of which ``most`` of ``rows`` hashes are expected not to be larger; all if there are no more."""
    return (1 << 63) - 1 if rows <= most else (most << 64) // rows - (1 << 63)


def in_sample(id_: Column, rows: int, most: int) -> Column:
    return F.xxhash64(id_) <= F.lit(hash_limit(rows, most))
