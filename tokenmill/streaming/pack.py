"""Incremental corpus packing (K1): documents arriving as files become packed sequence rows.

``run_stream_pack`` uses the same stateless operators as the batch plan (encode, chunk,
pack), so every micro-batch appends exactly the rows the batch job would write
for its documents. ``trigger(availableNow=True)`` processes what is there and
stops; the checkpoint in the shared folder makes restarts exactly-once.

``run_stream_files`` keeps numbered files of fixed size over the whole stream. Where the
next row goes depends on all rows before it, so the writer's place (file, rows in it) is
keyed state in Spark's state store, and goes on behind a restart. Two queries share the work:

1. documents are encoded once into a staged table, one row a document with its number of rows;
2. the staged table is read as a stream of (doc_id, n) alone. Each writer takes the documents of
   a micro-batch in order of their id and gives each its file and place; then the wide rows are
   read from the files of this micro-batch, joined with their places and written below
   ``batch=<id>``, so a batch that is repeated replaces its own files and nothing else.

Writers work side by side (``writer_col``, by default one for all); only two numbers a document go
through a writer's task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.operators import sequences
from tokenmill.session import scratch_path
from tokenmill.sources.readers import DOCUMENT_SCHEMA

STAGED = "doc_id long, ids array<int>, n long, writer string"
PLACES = "writer string, doc_id long, n long, path string, file_no long, start long, kept long"


def packed_stream(spark: SparkSession, source: str, ctx, sequence_size: int = 128) -> DataFrame:
    docs = spark.readStream.schema(DOCUMENT_SCHEMA).parquet(source)
    enc = docs.select("doc_id", ctx.encoder.encode_plain("text").alias("ids"))
    seqs = sequences.chunk_sequences(enc, "ids", sequence_size)
    packed = sequences.pack(seqs)
    return packed.select("doc_id", "row_no", sequences.packed_row(packed).alias("row"))


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def run_stream_pack(spark: SparkSession, source: str, sink: str, checkpoint: str, ctx, sequence_size: int = 128) -> None:
    stream = packed_stream(spark, source, ctx, sequence_size).writeStream.format("parquet").option("path", sink)
    _finish(stream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


def stream_pack(spark: SparkSession, sf_dir: str, ctx, sequence_size: int = 128) -> DataFrame:
    """Run the stream over the documents table itself (a file or a folder) and return what the sink holds."""
    sink = scratch_path(spark, "stream-sink")
    ckpt = scratch_path(spark, "stream-ckpt")
    source = f"{sf_dir.rstrip('/')}/documents.parque[t]"  # a pattern may name a file as well as a folder; this one matches one name
    run_stream_pack(spark, source, sink, ckpt, ctx, sequence_size)
    return spark.read.parquet(sink).select("doc_id", "row_no", "row")


def _places(capacity: int, crop: bool):
    """Places of a micro-batch's documents behind those placed so far; state: file number, rows in it."""

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        docs = pd.concat(list(frames)).sort_values("doc_id", kind="stable")  # two numbers and a path a document
        file_no, used = state.get if state.exists else (0, 0)
        n = docs["n"].to_numpy()
        files, starts, kept = [], [], []
        for rows in n.tolist():
            files.append(file_no)
            starts.append(used)
            if crop:
                kept.append(min(rows, capacity - used))
                used += rows
                if used >= capacity:
                    file_no, used = file_no + 1, 0
            else:
                kept.append(rows)
                file_no, used = file_no + (used + rows) // capacity, (used + rows) % capacity
        state.update((file_no, used))
        yield docs[["doc_id", "n", "path"]].assign(writer=key[0], file_no=files, start=starts, kept=kept)[[c.split()[0] for c in PLACES.split(", ")]]

    return run


def run_stream_files(spark: SparkSession, source: str, staged: str, sink: str, checkpoint: str, ctx, rows_per_file: int, crop: bool = False, sequence_size: int = 128, writer_col: str | None = None) -> None:
    """Bring ``sink/batch=<id>/writer=<w>/file_no=<n>`` up to date with all documents below ``source``."""
    docs = spark.readStream.schema(DOCUMENT_SCHEMA).parquet(source)
    writer = F.lit("all") if writer_col is None else F.coalesce(F.col(writer_col).cast("string"), F.lit(""))
    enc = docs.select("doc_id", ctx.encoder.encode_plain("text").alias("ids"), writer.alias("writer"))
    enc = enc.select("doc_id", "ids", F.floor(F.size("ids") / sequence_size).cast("long").alias("n"), "writer")
    _finish(enc.writeStream.format("parquet").option("path", staged).option("checkpointLocation", f"{checkpoint}/encode").outputMode("append").trigger(availableNow=True).start())

    narrow = spark.readStream.schema(STAGED).parquet(staged).where("n > 0").select("doc_id", "n", "writer", F.col("_metadata.file_path").alias("path"))
    placed = narrow.groupBy("writer").applyInPandasWithState(_places(rows_per_file, crop), PLACES, "file_no long, used long", "append", "NoTimeout")

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        at = f"{checkpoint}/places/batch={batch_id}"
        batch.write.mode("overwrite").parquet(at)  # the state is asked once
        places = session.read.schema(PLACES).parquet(at)
        paths = [r["path"] for r in places.select("path").distinct().collect()]  # files of this micro-batch
        if not paths:
            return
        rows = session.read.schema(STAGED).parquet(*paths).join(places.drop("n"), ["writer", "doc_id"])
        chunk = F.posexplode(sequences.chunks("ids", sequence_size)).alias("row_no", "tokens")
        rows = rows.select("writer", "doc_id", "file_no", "start", "kept", chunk).where("row_no < kept")
        at_row = F.col("start") + F.col("row_no")
        rows = rows.withColumns({"file_no": F.col("file_no") + F.floor(at_row / rows_per_file), "place": at_row % rows_per_file}).drop("start", "kept")
        out = rows.repartition("writer", "file_no").sortWithinPartitions("writer", "file_no", "place")
        out.write.mode("overwrite").partitionBy("writer", "file_no").parquet(f"{sink}/batch={batch_id}")

    stream = placed.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/files").outputMode("append")
    _finish(stream.trigger(availableNow=True).start())


def stream_files(spark: SparkSession, sf_dir: str, ctx, rows_per_file: int, crop: bool = False, arrivals: int = 3) -> DataFrame:
    """The documents arrive in ``arrivals`` parts by id, each handled by a query started anew; what the files hold then."""
    from tokenmill.sources.readers import read_table

    docs = read_table(spark, sf_dir, "documents")
    source, staged, sink, ckpt = (scratch_path(spark, f"files-{x}") for x in ("source", "staged", "sink", "ckpt"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    step = (high - low) // arrivals + 1
    for k in range(arrivals):
        docs.where(F.floor((F.col("doc_id") - low) / step) == k).write.mode("append").parquet(source)
        run_stream_files(spark, source, staged, sink, ckpt, ctx, rows_per_file, crop)
    return spark.read.option("basePath", sink).parquet(f"{sink}/batch=*")
