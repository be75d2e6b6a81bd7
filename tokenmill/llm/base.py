"""Shared helpers of the corpus operators: table reading, Arrow stages, written tables."""

from __future__ import annotations

import contextlib
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.session import scratch_path, ship_package


HEAP_SHARE = 0.5  # of the driver's heap limit; beyond it, its garbage is collected after a table is written


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it back: it is computed once and outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage if its heap has grown.

    Hundreds of short jobs make a heap grow to its limit, though little of it is in use: plans and
    task events of tables that are written. With the plans, Spark's cleaner drops their shuffle files and broadcasts.
    """
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        gc.collect()  # what only Python still refers to
        jvm.java.lang.System.gc()


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, or a variant of it that no column has (Spark compares names without case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def text_blocks(table: DataFrame, key: str, text: str, most_bytes: int) -> Iterator[pa.Table]:
    """A table of texts as Arrow tables of about ``most_bytes`` at most each, by a hash of the key.

    The table's size is measured first; a small one comes in one piece.
    """
    t = table.select(F.col(key).alias("key"), F.col(text).alias("text"))
    total = t.agg(F.sum(F.octet_length("text") + F.lit(16)).alias("b")).collect()[0]["b"] or 0
    n = max(1, -(-int(total) // most_bytes))
    for i in range(n):
        part = t if n == 1 else t.where(F.pmod(F.xxhash64("key", "text"), F.lit(n)) == i)
        yield part.toArrow()


def arrow_stage(f: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]) -> Callable:
    """A ``mapInArrow`` function from one that maps a batch to batches."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from f(b)

    return run


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    off = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, type=kind))


@contextlib.contextmanager
def conf(spark: SparkSession, **values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
