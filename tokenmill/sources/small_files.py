"""Many small files: one for each group of rows, in folders named like Spark's partitions.

Spark's writers reach a local (or mounted) file system through Hadoop's Java classes, which start a process for every
new file to set its mode, write a checksum file beside it and move each by its folder. There, tasks write the files
themselves: under a hidden name first, then renamed to a fixed one, so a repeated task replaces a file by the
same file. Any other store, mode or kind of key is left to Spark's writer.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder's name on the local file system, None if it lies elsewhere."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()
    return unquote(urlparse(uri).path) if uri.startswith("file:") else None


def can_write(df: DataFrame, path: str, keys) -> str | None:
    """The local folder if tasks can write there and the keys are whole numbers."""
    return local_folder(df.sparkSession, path) if all(isinstance(df.schema[k].dataType, _WHOLE) for k in keys) else None


class TextFile:
    """A line a row; null is an empty line."""

    suffix = ".txt"

    def __init__(self, name: str):
        self.file = open(name, "wb")

    def write(self, rows: pa.RecordBatch) -> None:
        self.file.write(b"".join((v.as_py() or "").encode() + b"\n" for v in rows.column(0)))

    def close(self) -> None:
        self.file.close()


class ParquetFile:
    suffix = ".parquet"

    def __init__(self, name: str):
        self.name, self.writer = name, None

    def write(self, rows: pa.RecordBatch) -> None:
        import pyarrow.parquet as pq

        if self.writer is None:
            self.writer = pq.ParquetWriter(self.name, rows.schema, compression="snappy")
        self.writer.write_batch(rows)

    def close(self) -> None:
        self.writer.close()


def write_files(df: DataFrame, folder: str, keys, kind, mode: str = "errorifexists") -> int:
    """A file for each run of rows with equal ``keys``, in ``folder/key=value/...``; returns their number.

    The rows of a group must stand together in one partition of ``df``. Nothing but the row at hand is held.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"file://{folder}" if folder.startswith("/") else folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        if mode != "overwrite":
            raise FileExistsError(folder)
        fs.delete(p, True)
    fs.mkdirs(p)
    keys = list(keys)
    n = len(keys)

    def run(batches):
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}"  # the same if the task is repeated
        held, key, target, hidden, files = None, None, None, None, 0

        def ended():
            held.close()
            os.replace(hidden, target)

        for b in batches:
            if not b.num_rows:
                continue
            values = list(zip(*(b.column(i).to_pylist() for i in range(n))))
            starts = [i for i in range(len(values)) if not i or values[i] != values[i - 1]]
            rest = b.select(b.schema.names[n:])
            for s, e in zip(starts, [*starts[1:], len(values)]):
                if held is None or values[s] != key:
                    if held is not None:
                        ended()
                    key = values[s]
                    place = os.path.join(folder, *(f"{k}={NO_VALUE if v is None else v}" for k, v in zip(keys, key)))
                    os.makedirs(place, exist_ok=True)
                    target, hidden = f"{place}/{name}{kind.suffix}", f"{place}/.{uuid.uuid4().hex}"
                    held = kind(hidden)
                    files += 1
                held.write(rest.slice(s, e - s))
        if held is not None:
            ended()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, *rest).mapInArrow(run, "files long").agg(F.sum("files")).collect()[0][0] or 0


@contextlib.contextmanager
def reading_many(spark: SparkSession):
    """Plans made and run inside list many folders in few tasks and read a thousand small files in one task."""
    values = {
        "spark.sql.files.openCostInBytes": str(128 << 10),
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(8 * spark.sparkContext.defaultParallelism),
    }
    old = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
