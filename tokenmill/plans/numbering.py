"""Order-dependent numbering without a single-task window.

A global ``row_number() over (order by k)`` or a running ``sum`` without a
partition key runs in one task. Here the frame is range-partitioned on the
order (all keys unique, so one hot value cannot overload a partition), each
partition numbers its own rows, and a small table of per-partition totals
(one row per partition and group, bounded by the partition count) gives every
partition its offset. Rows never leave their partition after the range shuffle.

The numbered frame is read twice (totals, then rows), so it is written once to the
shared folder: two separate evaluations could sample different range bounds, a
written table survives lost executors, and nothing stays persisted in the session.
Number narrow frames (keys only) and join rows to them where rows are wide.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOW_BITS = (1 << 33) - 1


def _sorted(df: DataFrame, group_cols, order_cols, num_partitions):
    keys = [*group_cols, *order_cols]
    if num_partitions is None:
        num_partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # An explicit partition count: AQE keeps it, so partition ids are stable.
    return df.repartitionByRange(num_partitions, *keys).sortWithinPartitions(*keys)


def _written(df: DataFrame) -> DataFrame:
    from tokenmill.session import scratch_path

    path = scratch_path(df.sparkSession, "numbered")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bounded(offsets: DataFrame, group_cols) -> DataFrame:
    """Without groups the offsets table has one row per partition: broadcast it.

    With groups it has up to partitions + groups rows, which grows with the
    number of groups; the join strategy is then left to AQE's runtime size check.
    """
    return F.broadcast(offsets) if not group_cols else offsets


def index_by_order(
    df: DataFrame,
    order_cols: list,
    out: str = "idx",
    group_cols: list | tuple = (),
    num_partitions: int | None = None,
) -> DataFrame:
    """0-based position of each row in ``order_cols`` order (within ``group_cols``).

    ``order_cols`` (with ``group_cols``) must identify rows uniquely for the
    result to be deterministic.
    """
    group_cols = list(group_cols)
    ordered = _sorted(df, group_cols, order_cols, num_partitions)
    local = ordered.withColumn("__pid", F.spark_partition_id()).withColumn(
        "__local", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))
    )
    local = _written(local)
    totals = local.groupBy("__pid", *group_cols).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__local").alias("__first")
    )
    w = Window.partitionBy(*group_cols).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    if not group_cols:
        # The totals table has one row per partition: a single small task.
        w = Window.partitionBy(F.lit(0)).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__base", F.coalesce(F.sum("__n").over(w), F.lit(0))).select(
        "__pid", *group_cols, "__base", "__first"
    )
    joined = local.join(_bounded(offsets, group_cols), ["__pid", *group_cols])
    return joined.withColumn(out, F.col("__base") + F.col("__local") - F.col("__first")).drop(
        "__pid", "__local", "__base", "__first"
    )


def prefix_sum(
    df: DataFrame,
    order_cols: list,
    weight: str,
    out: str = "start",
    group_cols: list | tuple = (),
    num_partitions: int | None = None,
) -> DataFrame:
    """Exclusive running sum of ``weight`` in ``order_cols`` order (within ``group_cols``).

    Per-partition running sums are computed with pandas over Arrow batches
    (the partition's rows stay in place), then shifted by partition offsets.
    """
    group_cols = list(group_cols)
    # range bounds are sampled from the frame before it is exchanged: what it takes to make it is done once
    ordered = _sorted(_written(df), group_cols, order_cols, num_partitions)
    schema = T.StructType(
        ordered.schema.fields
        + [T.StructField("__pid", T.IntegerType()), T.StructField("__local", T.LongType())]
    )

    def running(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        carry: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            w = pdf[weight].fillna(0).astype("int64")
            if group_cols:
                keys = pdf[group_cols].astype(str).agg("\x1f".join, axis=1)
                csum = w.groupby(keys.values).cumsum()
                base = keys.map(lambda k: carry.get(k, 0)).astype("int64")
                pdf["__local"] = (csum - w + base).values
                last = pd.DataFrame({"k": keys.values, "c": (csum + base).values}).groupby("k")["c"].last()
                carry.update(last.to_dict())
            else:
                c0 = carry.get("", 0)
                csum = w.cumsum()
                pdf["__local"] = (csum - w + c0).values
                carry[""] = int(c0 + w.sum())
            pdf["__pid"] = pid
            yield pdf

    local = _written(ordered.mapInPandas(running, schema))
    totals = local.groupBy("__pid", *group_cols).agg(F.sum(F.col(weight)).alias("__n"))
    if group_cols:
        w = Window.partitionBy(*group_cols).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    else:
        w = Window.partitionBy(F.lit(0)).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__base", F.coalesce(F.sum("__n").over(w), F.lit(0))).select(
        "__pid", *group_cols, "__base"
    )
    joined = local.join(_bounded(offsets, group_cols), ["__pid", *group_cols])
    return joined.withColumn(out, (F.col("__base") + F.col("__local")).cast("long")).drop(
        "__pid", "__local", "__base"
    )


def nearest(queries: DataFrame, at: str, points: DataFrame, value: str, out: str, forward: bool = True, num_partitions: int | None = None) -> DataFrame:
    """Each query row with ``out``: the smallest point not below ``at`` (the largest not above it, unless ``forward``), or null.

    One sorted pass: queries and points are range-partitioned together, every partition
    carries the last point it has seen along its rows, and a query that no point of its own
    partition answers takes the nearest one of the partitions before it (a table of one row
    per partition, which is broadcast). ``at`` and ``value`` are longs; points need not be unique.
    """
    if num_partitions is None:
        num_partitions = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sign = -1 if forward else 1  # the pass runs downwards for the next point
    row = F.struct(*queries.columns)
    q = queries.select((F.lit(sign) * F.col(at)).alias("__v"), F.lit(1).alias("__kind"), row.alias("__row"))
    p = points.select((F.lit(sign) * F.col(value)).alias("__v"), F.lit(0).alias("__kind"), F.lit(None).cast(q.schema["__row"].dataType).alias("__row")).distinct()
    both = q.unionByName(p).repartitionByRange(num_partitions, "__v", "__kind").sortWithinPartitions("__v", "__kind")
    schema = T.StructType([*both.schema.fields, T.StructField("__found", T.LongType()), T.StructField("__pid", T.IntegerType())])

    def carried(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        pid, last = TaskContext.get().partitionId(), None
        for b in batches:
            v, kind = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            seen = pd.Series(v, dtype="Int64").where(kind == 0).ffill()
            if last is not None:
                seen = seen.fillna(last)
            if len(seen) and not pd.isna(seen.iloc[-1]):
                last = int(seen.iloc[-1])
            found = pa.Array.from_pandas(seen).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, found, pa.array([pid] * b.num_rows, pa.int32())], names=[*b.schema.names, "__found", "__pid"])

    local = _written(both.mapInArrow(carried, schema))
    lasts = local.where("__kind = 0").groupBy("__pid").agg(F.max("__v").alias("__last"))
    pids = local.select("__pid").distinct().join(lasts, "__pid", "left")  # one row per partition
    w = Window.partitionBy(F.lit(0)).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    before = pids.select("__pid", F.max("__last").over(w).alias("__before"))
    joined = local.where("__kind = 1").join(F.broadcast(before), "__pid")
    return joined.select("__row.*", (F.lit(sign) * F.coalesce("__found", "__before")).alias(out))
