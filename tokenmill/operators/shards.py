"""Shard assignment and shuffles with keyed-hash randomness (H2-H5, H7, H9, G4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.rng import uniform
from tokenmill.plans.numbering import index_by_order


def assign_shard(df: DataFrame, num_shards: int, key_cols=("doc_id", "row_no"), seed: str = "shard", out="shard") -> DataFrame:
    """Uniform shard number in [0, num_shards) per row."""
    if not 0 < num_shards <= 255:
        raise ValueError("shard numbers must fit 8 bits")
    return df.withColumn(out, F.floor(uniform(seed, *key_cols) * num_shards).cast("int"))


def shuffle_key(df: DataFrame, key_cols=("doc_id", "row_no"), seed: str = "order", out: str = "h") -> DataFrame:
    """A random sort key per row; it has 32 bits, so ties happen and the key columns must break them."""
    return df.withColumn(out, uniform(seed, *key_cols))


def rank_within_shard(df: DataFrame, key_cols=("doc_id", "row_no"), shard_col="shard", seed: str = "order", out="pos") -> DataFrame:
    """0-based position of each row in its shard's random order (partition offsets, no one-task window)."""
    keyed = shuffle_key(df, key_cols, seed)
    return index_by_order(keyed, ["h", *key_cols], out=out, group_cols=[shard_col])


def batch_numbers(df: DataFrame, batch_size: int, key_cols=("doc_id", "row_no"), shard_col="shard", seed: str = "order") -> DataFrame:
    """Batch index inside each shard; the short last batch is kept (pretraining reads it too)."""
    ranked = rank_within_shard(df, key_cols, shard_col, seed, out="pos")
    return ranked.withColumn("batch_no", F.floor(F.col("pos") / batch_size).cast("long"))


def shard_order(shards: DataFrame, shard_col="shard", seed: str = "files", out="file_rank") -> DataFrame:
    """Random order of shard files: rank of each shard by a hash of its number."""
    keyed = shards.select(shard_col).distinct().withColumn("__h", uniform(seed, shard_col))
    return index_by_order(keyed, ["__h", shard_col], out=out).drop("__h")


def shuffle_rows(df: DataFrame, key_cols, seed: str = "rows", out: str = "rank") -> DataFrame:
    """Full permutation: the rank of every row in a keyed-hash order."""
    keyed = df.withColumn("__h", uniform(seed, *key_cols))
    return index_by_order(keyed, ["__h", *key_cols], out=out).drop("__h")


def nth_smallest(df: DataFrame, key_cols, n: int, seed: str):
    """Condition that holds for exactly the ``n`` rows that come first by keyed hash, then key.

    Selection by radix: counts by the upper 16 bits of the hash (at most 65,536 rows reach
    the driver) name the bucket that holds the n-th row, counts by the lower 16 bits inside it
    the hash value. Only rows of that one value are ordered by their keys.
    """
    x = (uniform(seed, *key_cols) * (1 << 32)).cast("long")
    high, low = F.shiftright(x, 16), x.bitwiseAND(F.lit(0xFFFF))
    rest, found = n, []
    for part, inside in ((high, F.lit(True)), (low, None)):
        within = high == found[0] if inside is None else inside
        counts = df.where(within).groupBy(part.alias("b")).count().toArrow()
        for b, c in sorted(zip(counts["b"].to_pylist(), counts["count"].to_pylist())):
            if rest <= c:
                found.append(b)
                break
            rest -= c
        else:
            return F.lit(True)  # fewer than n rows
    value = (found[0] << 16) + found[1]
    key = F.struct(*key_cols)
    last = df.where(x == value).select(key.alias("k")).orderBy("k").limit(rest).agg(F.max("k")).scalar()
    return (x < value) | ((x == value) & (key <= last))


def validation_split(df: DataFrame, key_cols, share: float | None = None, n: int | None = None, seed: str = "split", out="is_validation") -> DataFrame:
    """Marks rows to hold out by a keyed hash: a ``share`` of them, or exactly ``n``.

    A share needs no exchange; for ``n`` rows see ``nth_smallest``.
    """
    if (share is None) == (n is None):
        raise ValueError("give either a share or a number of rows")
    if n is None:
        return df.withColumn(out, uniform(seed, *key_cols) < share)
    if n <= 0:
        return df.withColumn(out, F.lit(False))
    return df.withColumn(out, nth_smallest(df, key_cols, n, seed))


def first_batch(df: DataFrame, batch_size: int, shards: DataFrame | None = None, key_cols=("doc_id", "row_no"), shard_col="shard", seed: str = "order", files_seed: str = "files") -> DataFrame:
    """The first batch of the first shard file in the random file order, in its order.

    The first file is a minimum over the shard numbers (of ``shards``, a frame that may be
    narrower than ``df``), its batch a top-k of that shard alone: no shard is ranked as a whole.
    """
    numbers = (df if shards is None else shards).select(shard_col)
    first = numbers.agg(F.min(F.struct(uniform(files_seed, shard_col).alias("u"), F.col(shard_col).alias("s"))).alias("m")).select("m.s").scalar()
    return shuffle_key(df, key_cols, seed).where(F.col(shard_col) == first).orderBy("h", *key_cols).limit(batch_size)
