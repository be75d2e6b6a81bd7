"""Keyed-hash randomness.

``rand(seed)`` depends on how rows fall into partitions; every random step
here instead hashes (seed word, row keys...) so results are the same for any
partitioning, on re-execution after a lost executor, and in SQL engines.

u(seed, k1, k2, ...) = int(first 8 hex digits of md5("seed|k1|k2|...")) / 2**32
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = 4294967296.0  # 2**32


def digest(seed: str, *keys) -> Column:
    parts = [F.lit(str(seed))] + [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def _hex_uniform(hexcol: Column, start: int) -> Column:
    return F.conv(F.substring(hexcol, start, 8), 16, 10).cast("bigint") / F.lit(_SCALE)


def uniform(seed: str, *keys) -> Column:
    """Uniform double in [0, 1) keyed by ``seed`` and the key columns."""
    return _hex_uniform(digest(seed, *keys), 1)
