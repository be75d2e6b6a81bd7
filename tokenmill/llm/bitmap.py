"""Approximate membership of 64-bit values in a bounded number of bits.

Used only to leave rows out of an exchange early; an exact join always follows, so a
false hit costs time and never changes a result. A table too large for the bits makes
more rows pass, up to all of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 1 << 16, 1 << 27  # 16 MB at most reach the driver and the executors
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxhash64(x: np.ndarray) -> np.ndarray:
    """What Spark's ``xxhash64`` gives for a column of longs."""
    x = x.astype(np.int64).view(np.uint64)
    h = np.full(len(x), np.uint64(42) + _P5 + np.uint64(8))
    h ^= _rotated(x * _P2, 31) * _P1
    h = _rotated(h, 27) * _P1 + _P4
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    return h ^ (h >> np.uint64(32))


def build(values: DataFrame, column: str, n: int, each: int = 16) -> np.ndarray:
    """Bits of all values of a long column; ``n``: about how many differ; ``each``: bits for one of them (1 in ``each`` others passes)."""
    bits = LEAST
    while bits < each * n and bits < MOST:
        bits *= 2
    slot = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits))
    words = values.where(F.col(column).isNotNull()).select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(s, 64) AS int))")).alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out


def test(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = xxhash64(values) % np.uint64(len(bits) * 64)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)).astype(np.int64)) & 1 == 1
