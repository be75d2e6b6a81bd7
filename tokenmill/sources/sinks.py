"""Sinks: packed sequence files, shards, predictions, vocabularies, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.plans.numbering import index_by_order
from tokenmill.sources import small_files

#: Tasks put their own files in place. Many files would otherwise be moved one by one by the driver at the end.
BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def write_tasks(df: DataFrame) -> int:
    """Tasks for a write of many small files: what they cost is their number, which no estimate by bytes sees."""
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_texts(df: DataFrame, path: str, id_col: str, text_col: str) -> None:
    """One text file per document, ``<id_col>=<id>/part-*.txt``, a line break behind each text."""
    texts = df.select(id_col, text_col).repartition(write_tasks(df), id_col)
    folder = small_files.can_write(texts, path, [id_col])
    if folder:
        small_files.write_files(texts.sortWithinPartitions(id_col), folder, [id_col], small_files.TextFile)
    else:
        texts.write.options(**BY_TASK).partitionBy(id_col).text(path)


def number_files(df: DataFrame, rows_per_file: int, order_cols=("doc_id", "row_no")) -> DataFrame:
    """``file_no = floor(global_row / rows_per_file)`` in document order (partition offsets)."""
    indexed = index_by_order(df, list(order_cols), out="__row")
    return indexed.withColumn("file_no", F.floor(F.col("__row") / rows_per_file).cast("int")).withColumnRenamed(
        "__row", "global_row"
    )


def write_packed(df: DataFrame, path: str, rows_per_file: int, order_cols=("doc_id", "row_no"), mode="overwrite") -> None:
    """Fixed rows per numbered file, no row lost: ``file_no=<n>/`` directories.

    Each file number is one write task holding exactly its rows (bounded by
    ``rows_per_file``), so there is no hot partition.
    """
    numbered = number_files(df, rows_per_file, order_cols)
    (
        numbered.repartition("file_no")
        .sortWithinPartitions("file_no", "global_row")
        .write.mode(mode)
        .options(**BY_TASK)
        .partitionBy("file_no")
        .parquet(path)
    )


def write_packed_binary(df: DataFrame, path: str, rows_per_file: int, row_len: int, dtype: str = "<u2", order_cols=("doc_id", "row_no")) -> None:
    """Headerless fixed-width files ``<n>.npy`` of ``rows_per_file`` rows each, in document order; the last one is filled up with zeros.

    ``df`` has a ``row`` of numbers. Every file is written by one task as a whole and gets its name
    when the job commits, so a lost or repeated task leaves no half file.
    """
    from tokenmill.sources.packed_rows import PackedRows

    df.sparkSession.dataSource.register(PackedRows)
    numbered = number_files(df.select(*order_cols, "row"), rows_per_file, order_cols)
    files = numbered.repartition("file_no").sortWithinPartitions("file_no", "global_row").select("file_no", F.col("row").cast("array<long>").alias("row"))
    files.write.format(PackedRows.name()).options(row_len=row_len, dtype=dtype, rows_per_file=rows_per_file).mode("append").save(path)


def write_shards(
    df: DataFrame,
    path: str,
    shard_col="shard",
    order_col="h",
    key_cols=("doc_id", "row_no"),
    num_shards: int = 100,
    rows_per_file: int = 100_000,
    total_rows: int | None = None,
    mode="overwrite",
) -> int:
    """One folder per shard with exactly its rows, in random (``h``) order.

    ``bucket = floor(h * buckets)`` splits a shard into ordered sub-folders of about
    ``rows_per_file`` rows, so a shard of any size is spread over many tasks. The number
    of buckets follows from the rows in the table (``total_rows``, counted if not given)
    and is returned. Shard numbers and ``h`` are uniform hashes, so (shard, bucket) groups
    are of equal size up to chance; a task may get several. Rows with equal ``h`` stand in
    the order of their key. Reading ``shard=<n>/`` bucket by bucket gives the rows in order.
    """
    total = df.count() if total_rows is None else total_rows
    buckets_per_shard = max(1, -(-total // (num_shards * rows_per_file)))
    b = F.least(F.floor(F.col(order_col) * buckets_per_shard), F.lit(buckets_per_shard - 1)).cast("int")
    staged = df.withColumn("bucket", b)
    staged = staged.repartition(write_tasks(df), shard_col, "bucket").sortWithinPartitions(shard_col, "bucket", order_col, *key_cols)
    folder = small_files.can_write(staged, path, [shard_col, "bucket"]) if mode == "overwrite" else None
    if folder:
        small_files.write_files(staged, folder, [shard_col, "bucket"], small_files.ParquetFile, mode)
    else:
        staged.write.mode(mode).options(**BY_TASK).partitionBy(shard_col, "bucket").parquet(path)
    return buckets_per_shard


def write_crop(rows: DataFrame, assignment: DataFrame, path: str, order_cols=("doc_id", "row_no"), mode="overwrite") -> None:
    """Numbered files in crop mode: rows that do not fit into their document's file are left out."""
    from tokenmill.operators.crop import crop_rows

    kept = crop_rows(rows, assignment)
    kept.repartition("file_no").sortWithinPartitions("file_no", *order_cols).write.mode(mode).options(**BY_TASK).partitionBy("file_no").parquet(path)


def write_predictions(df: DataFrame, path: str, subset_col="subset", cols=("index", "prediction"), mode="overwrite") -> None:
    """``index<TAB>prediction`` without header, one folder per subset."""
    df.select(subset_col, *cols).write.mode(mode).partitionBy(subset_col).option("sep", "\t").option(
        "header", False
    ).csv(path)


def read_predictions(spark, path: str) -> DataFrame:
    return spark.read.schema("index LONG, prediction STRING, subset STRING").option("sep", "\t").csv(path)


def save_vocab(vocab: DataFrame, path: str, mode="overwrite") -> None:
    vocab.coalesce(1).write.mode(mode).parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Append metric events (``run, epoch, step, name, value``) to a Parquet table."""
    metrics.write.mode("append").partitionBy("run").parquet(path)


def write_tsv(df: DataFrame, path: str, mode="overwrite") -> None:
    """Header TSV with double-quote quoting (pair files)."""
    options = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(**options).csv(path)
