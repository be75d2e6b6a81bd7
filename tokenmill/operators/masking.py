"""Token masking with keyed-hash randomness (D5) and its statistics (F8).

Per token: choice 0 = context (not in the loss), 1 = replaced by the mask id,
2 = replaced by a random id in [0, vocab_size), 3 = kept; choices 1-3 are
predicted. The draws hash (seed, doc_id, row_no, position), so the result does
not depend on partitioning and survives re-execution unchanged.
"""

from __future__ import annotations

import hashlib
import math
import struct
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.config import MaskingConfig

_SCALE = 4294967296.0


def thresholds(cfg: MaskingConfig) -> tuple[float, float, float]:
    """Cumulative bounds of choices 0, 1, 2 (choice 3 takes the rest)."""
    p0 = 1.0 - cfg.mask_p - cfg.random_p - cfg.keep_p
    return p0, p0 + cfg.mask_p, p0 + cfg.mask_p + cfg.random_p


def _u(hexcol: Column, start: int) -> Column:
    return F.conv(F.substring(hexcol, start, 8), 16, 10).cast("bigint") / F.lit(_SCALE)


def token_digests(tokens, key_cols: list, seed: str = "mask") -> Column:
    """One md5 hex digest per token position, keyed by (seed, keys..., position)."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    keys = [F.col(k) if isinstance(k, str) else k for k in key_cols]
    return F.transform(tokens, lambda t, i: F.md5(F.concat_ws("|", F.lit(seed), *keys, i)))


def choice_from_digests(digests, cfg: MaskingConfig = MaskingConfig()) -> Column:
    t1, t2, t3 = thresholds(cfg)

    def pick(h):
        u = _u(h, 1)
        return (u >= F.lit(t1)).cast("int") + (u >= F.lit(t2)).cast("int") + (u >= F.lit(t3)).cast("int")

    return F.transform(digests, pick)


def random_ids_from_digests(digests, vocab_size: int) -> Column:
    return F.transform(digests, lambda h: F.floor(_u(h, 9) * vocab_size).cast("int"))


_SHIFTS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
_SINES = [int(abs(math.sin(i + 1)) * 4294967296) for i in range(64)]
_HASHED = 8192  # messages of one block that are hashed side by side


def _md5_blocks(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two 32-bit numbers of the hex digests of padded messages, a column of 16 words each."""
    state = [np.full(m.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = state
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += m[g]
        f += np.uint32(_SINES[i])
        s = _SHIFTS[i // 16][i % 4]
        a, d, c, b = d, c, b, b + ((f << np.uint32(s)) | (f >> np.uint32(32 - s)))
    return (a + state[0]).byteswap(), (b + state[1]).byteswap()


@cache
def _endings(length: int, n: int) -> np.ndarray | None:
    """What follows a prefix of ``length`` bytes in the padded messages of positions 0 to n - 1; None if one needs a second block."""
    ends = [str(i).encode() for i in range(n)]
    if length + len(ends[-1]) > 55:
        return None
    rows = [(e + b"\x80").ljust(56 - length, b"\0") + (8 * (length + len(e))).to_bytes(8, "little") for e in ends]
    return np.frombuffer(b"".join(rows), np.uint8).reshape(n, 64 - length)


def _draws(prefixes: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform numbers for each position of each row, from md5(prefix + position), all rows in one array."""
    total = int(sizes.sum())
    first, second = np.empty(total, np.uint32), np.empty(total, np.uint32)
    block, where, at = np.empty((_HASHED, 64), np.uint8), np.empty(_HASHED, np.int64), 0

    def flush(n):
        words = np.ascontiguousarray(block[:n].view("<u4").T)
        first[where[:n]], second[where[:n]] = _md5_blocks(words)

    begin = 0
    for prefix, size in zip(prefixes, sizes.tolist()):
        # a power of two bounds the number of tables that are kept
        ends = _endings(len(prefix), 1 << (size - 1).bit_length()) if 0 < size <= _HASHED else None
        if ends is None:
            for i in range(size):
                first[begin + i], second[begin + i] = struct.unpack(">II", hashlib.md5(prefix + b"%d" % i).digest()[:8])
        else:
            if at + size > _HASHED:
                flush(at)
                at = 0
            block[at : at + size, : len(prefix)] = np.frombuffer(prefix, np.uint8)
            block[at : at + size, len(prefix) :] = ends[:size]
            where[at : at + size] = np.arange(begin, begin + size)
            at += size
        begin += size
    if at:
        flush(at)
    return first / _SCALE, second / _SCALE


def _mask_udf(element, cfg, mask_id, vocab_size, keep_choice):
    t1, t2, t3 = thresholds(cfg)
    fields = {"input": element, "mask": T.BooleanType()} | ({"choice": T.IntegerType()} if keep_choice else {})

    @F.arrow_udf(T.StructType([T.StructField(k, T.ArrayType(v)) for k, v in fields.items()]))
    def mask_batch(tokens: pa.Array, prefixes: pa.Array) -> pa.Array:
        null = tokens.is_null()
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        u1, u2 = _draws([p.encode() for p in prefixes.to_pylist()], sizes)
        choice = (u1 >= t1).astype(np.int32) + (u1 >= t2) + (u1 >= t3)
        new = pa.array(np.where(choice == 1, mask_id, np.floor(u2 * vocab_size).astype(np.int64)))
        flat = tokens.flatten()
        out = {"input": pc.if_else(pa.array((choice == 1) | (choice == 2)), new.cast(flat.type), flat), "mask": pa.array(choice > 0)}
        if keep_choice:
            out["choice"] = pa.array(choice)
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, v, mask=null) for v in out.values()], names=list(out))

    return mask_batch


def mask_tokens(
    df: DataFrame,
    mask_id: int,
    vocab_size: int,
    cfg: MaskingConfig = MaskingConfig(),
    tokens_col: str = "tokens",
    key_cols=("doc_id", "row_no"),
    seed: str = "mask",
    keep_choice: bool = False,
    engine: str = "arrow",
) -> DataFrame:
    """Adds ``input, target, mask`` (and ``choice``) for every sequence row; drops ``tokens``.

    ``engine="arrow"`` (default) hashes the positions of many rows side by side in one
    Arrow-batched function; ``engine="sql"`` uses built-in higher-order functions, which
    hash one position after the other. Both give identical results.
    """
    element = df.schema[tokens_col].dataType.elementType
    if engine == "sql" or not isinstance(element, T.IntegerType):
        return mask_tokens_sql(df, mask_id, vocab_size, cfg, tokens_col, key_cols, seed, keep_choice)
    udf = _mask_udf(element, cfg, mask_id, vocab_size, keep_choice)
    # keys become text in the JVM, as in the SQL form: a key that is null is left out
    prefix = F.concat_ws("|", F.lit(seed), *[F.col(k) if isinstance(k, str) else k for k in key_cols], F.lit(""))
    staged = df.withColumn("__m", udf(F.col(tokens_col), prefix))
    out = staged.select(
        *[c for c in df.columns if c != tokens_col],
        F.col("__m.input").alias("input"),
        F.col(tokens_col).alias("target"),
        F.col("__m.mask").alias("mask"),
        *([F.col("__m.choice").alias("choice")] if keep_choice else []),
    )
    return out


def mask_tokens_sql(
    df: DataFrame,
    mask_id: int,
    vocab_size: int,
    cfg: MaskingConfig = MaskingConfig(),
    tokens_col: str = "tokens",
    key_cols=("doc_id", "row_no"),
    seed: str = "mask",
    keep_choice: bool = False,
) -> DataFrame:
    """Adds ``input, target, mask`` (and ``choice``) for every sequence row; drops ``tokens``.

    The digest array is one projected column, referenced twice, so each token is hashed once.
    """
    staged = df.withColumn("__h", token_digests(tokens_col, list(key_cols), seed))
    staged = staged.withColumn("__choice", choice_from_digests("__h", cfg)).withColumn(
        "__rnd", random_ids_from_digests("__h", vocab_size)
    )
    out = staged.select(
        *[c for c in df.columns if c != tokens_col],
        F.zip_with(
            F.arrays_zip(F.col(tokens_col).alias("t"), F.col("__choice").alias("c")),
            F.col("__rnd"),
            lambda tc, r: F.when(tc["c"] == 1, F.lit(mask_id)).when(tc["c"] == 2, r).otherwise(tc["t"]),
        ).alias("input"),
        F.col(tokens_col).alias("target"),
        F.transform("__choice", lambda c: c > 0).alias("mask"),
        F.col("__choice").alias("choice"),
    )
    return out if keep_choice else out.drop("choice")


def mask_stats(masked: DataFrame, choice_col: str = "choice") -> DataFrame:
    """Positions per choice and their share: ``choice, positions, share``."""
    per = masked.select(F.explode(choice_col).alias("choice")).groupBy("choice").agg(
        F.count(F.lit(1)).alias("positions")
    )
    # a row for each kind of choice: the total is their sum, no second pass
    rows = per.agg(F.collect_list(F.struct("choice", "positions")).alias("r"), F.sum("positions").alias("total"))
    return rows.select("total", F.inline("r")).select("choice", "positions", (F.col("positions") / F.col("total")).alias("share"))
