"""Sequence and array operators: chunking, packing, id halves, flat rows, batches, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.plans.numbering import index_by_order

META_WIDTH = 3  # id_hi, id_lo, row_no


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chunks(tokens, sequence_size: int) -> Column:
    """Contiguous chunks of ``sequence_size``; the remainder is dropped.

    A token array shorter than one sequence yields an empty array (``sequence(0, -1)``
    would be ``[0, -1]`` in Spark, hence the guard).
    """
    tokens = _c(tokens)
    n = F.floor(F.size(tokens) / sequence_size).cast("int")
    starts = F.sequence(F.lit(0), n - 1)
    cut = F.transform(starts, lambda i: F.slice(tokens, i * sequence_size + 1, sequence_size))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<array<int>>"))


def chunk_sequences(df: DataFrame, tokens_col: str = "ids", sequence_size: int = 128, keep=("doc_id",)) -> DataFrame:
    """Documents -> one row per sequence: ``*keep, row_no, tokens`` (row_no = position in the document)."""
    return df.select(*keep, F.posexplode(chunks(tokens_col, sequence_size)).alias("row_no", "tokens"))


def encode_id_hi(doc_id) -> Column:
    return F.shiftright(_c(doc_id), 16)


def encode_id_lo(doc_id) -> Column:
    return _c(doc_id).bitwiseAND(F.lit(0xFFFF))


def decode_id(hi, lo) -> Column:
    return F.shiftleft(_c(hi).cast("long"), 16).bitwiseOR(_c(lo).cast("long").bitwiseAND(F.lit(0xFFFF)))


def pack(df: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Add the packed meta columns ``id_hi, id_lo`` next to ``row_no`` and ``tokens``."""
    return df.withColumn("id_hi", encode_id_hi(doc_col)).withColumn("id_lo", encode_id_lo(doc_col))


def packed_row(df: DataFrame) -> Column:
    """The fixed-width raw row: id_hi, id_lo, row_no, tokens..."""
    return F.concat(F.array(F.col("id_hi").cast("int"), F.col("id_lo").cast("int"), F.col("row_no").cast("int")), F.col("tokens"))


def flat_row(meta_cols=("id_hi", "id_lo", "row_no"), input_col="input", target_col="target", mask_col="mask") -> Column:
    """meta + input + target + mask (as 0/1) in one fixed-width int array."""
    meta = F.array(*[F.col(c).cast("int") for c in meta_cols])
    mask = F.transform(F.col(mask_col), lambda m: m.cast("int"))
    return F.concat(meta, F.col(input_col), F.col(target_col), mask)


def unpack_row(row, sequence_size: int) -> dict[str, Column]:
    """Inverse of ``flat_row``: meta, input, target, mask columns."""
    row = _c(row)
    s = sequence_size
    return {
        "meta": F.slice(row, 1, META_WIDTH),
        "input": F.slice(row, META_WIDTH + 1, s),
        "target": F.slice(row, META_WIDTH + s + 1, s),
        "mask": F.transform(F.slice(row, META_WIDTH + 2 * s + 1, s), lambda m: m != 0),
    }


def key_mask(ids, pad_id: int) -> Column:
    """True where the key position is a real token."""
    return F.transform(_c(ids), lambda t: t != F.lit(pad_id))


def masked_positions(df: DataFrame, keep=("doc_id", "row_no"), target_col="target", mask_col="mask") -> DataFrame:
    """Rows ``*keep, pos, target`` for the positions that count for the loss."""
    z = F.arrays_zip(F.col(target_col).alias("t"), F.col(mask_col).alias("m"))
    exploded = df.select(*keep, F.posexplode(z).alias("pos", "z"))
    return exploded.filter(F.col("z.m")).select(*keep, "pos", F.col("z.t").alias("target"))


def batches(
    df: DataFrame,
    order_cols: list,
    batch_size: int,
    drop_last: bool = True,
    group_cols=(),
    out: str = "batch_no",
) -> DataFrame:
    """Consecutive fixed-size batches in ``order_cols`` order (within ``group_cols``).

    ``drop_last`` removes the short last batch of each group. Without groups, fewer
    rows than one batch are an error then, as nothing would be left.
    """
    if batch_size <= 0:
        raise ValueError("batch size must be positive")
    indexed = index_by_order(df, order_cols, out="__row", group_cols=group_cols)
    indexed = indexed.withColumn(out, F.floor(F.col("__row") / batch_size).cast("long"))
    if drop_last:
        group_cols = list(group_cols)
        if group_cols:
            sizes = indexed.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("__n"))
            indexed = indexed.join(sizes, group_cols)
            full = F.floor(F.col("__n") / batch_size) * batch_size
            indexed = indexed.filter(F.col("__row") < full).drop("__n")
        else:
            n = check_batchable(indexed, batch_size)  # counts the written numbering, not the input again
            indexed = indexed.filter(F.col("__row") < n // batch_size * batch_size)
    return indexed.drop("__row")


def check_batchable(df: DataFrame, batch_size: int) -> int:
    n = df.count()
    if not (n >= batch_size > 0):
        raise ValueError(f"need at least one full batch: {n} rows, batch size {batch_size}")
    return n
