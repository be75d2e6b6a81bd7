"""Data checks: zero rows, value ranges, quality assertions, dataset size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_zero_row(arr) -> F.Column:
    arr = F.col(arr) if isinstance(arr, str) else arr
    return ~F.exists(arr, lambda x: x != 0)


def zero_row_report(df: DataFrame, row_col: str = "row", chunk_cols=("doc_id",)) -> DataFrame:
    """Row mode: all-zero rows. Chunk mode: chunks (documents) made only of zero rows."""
    z = is_zero_row(row_col)
    per_chunk = df.groupBy(*chunk_cols).agg(F.bool_and(z).alias("__all_zero"), F.count_if(z).alias("__zero_rows"))
    return per_chunk.agg(
        F.sum("__zero_rows").alias("zero_rows"),
        F.count_if("__all_zero").alias("zero_chunks"),
        F.count(F.lit(1)).alias("chunks"),
    )


def assert_no_zero_chunks(df: DataFrame, row_col: str = "row", chunk_cols=("doc_id",), mode: str = "chunk") -> None:
    rep = zero_row_report(df, row_col, chunk_cols).first()
    bad = rep["zero_chunks"] if mode == "chunk" else rep["zero_rows"]
    if bad:
        raise ValueError(f"column {row_col!r} holds only zeros in {bad} {'rows' if mode == 'row' else 'groups of ' + ', '.join(chunk_cols)}; zeros mark padding")


def range_report(df: DataFrame, col: str, lo: int, hi: int) -> DataFrame:
    """min / max of an int column (arrays are flattened) and how many values fall outside [lo, hi]."""
    dtype = dict(df.dtypes)[col]
    vals = df.select(F.explode(col).alias("v")) if dtype.startswith("array") else df.select(F.col(col).alias("v"))
    return vals.agg(
        F.min("v").alias("min_value"),
        F.max("v").alias("max_value"),
        F.count_if((F.col("v") < lo) | (F.col("v") > hi)).alias("out_of_range"),
    )


def range_reports(df: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """``name, min_value, max_value, out_of_range`` of several int columns (or arrays) in one pass."""
    kinds = dict(df.dtypes)
    lo = lambda c: F.array_min(c) if kinds[c].startswith("array") else F.col(c)
    hi = lambda c: F.array_max(c) if kinds[c].startswith("array") else F.col(c)

    def outside(c, a, b):
        bad = lambda v: (v < a) | (v > b)
        return F.size(F.filter(c, bad)) if kinds[c].startswith("array") else bad(F.col(c)).cast("int")

    one = df.agg(
        F.array(
            *(
                F.struct(F.lit(c).alias("name"), F.min(lo(c)).cast("long").alias("min_value"), F.max(hi(c)).cast("long").alias("max_value"), F.sum(outside(c, a, b)).alias("out_of_range"))
                for c, (a, b) in bounds.items()
            )
        ).alias("r")
    )
    return one.select(F.inline("r"))


def assert_in_range(df: DataFrame, col: str, lo: int, hi: int) -> None:
    rep = range_report(df, col, lo, hi).first()
    if rep["out_of_range"]:
        raise ValueError(f"{col}: {rep['out_of_range']} values outside [{lo}, {hi}]")


def dataset_size(df: DataFrame, row_col: str | None = None) -> int:
    """Number of real rows; with ``row_col`` all-zero padding rows are not counted."""
    if row_col is None:
        return df.count()
    return df.filter(~is_zero_row(row_col)).count()


def quality_report(
    scored: DataFrame | None = None,
    loss_col: str = "loss",
    pairs: DataFrame | None = None,
    label_id_col: str = "label_id",
) -> DataFrame:
    """NaN losses and unknown labels (both must be 0)."""
    parts = []
    if scored is not None:
        parts.append(scored.agg(F.count_if(F.isnan(loss_col)).alias("nan_losses")))
    if pairs is not None:
        parts.append(pairs.agg(F.count_if(F.col(label_id_col).isNull()).alias("unknown_labels")))
    out = parts[0]
    for p in parts[1:]:
        out = out.select("*", *[p.select(c).scalar().alias(c) for c in p.columns])
    return out


def assert_counts_sum(per_shard: DataFrame, total: int, rows_col: str = "rows") -> None:
    s = per_shard.agg(F.sum(rows_col)).first()[0] or 0
    if s != total:
        raise ValueError(f"row counters sum to {s}, dataset has {total}")
