"""Crop-mode file assignment (A6): the overflowing tail of a document is lost.

A file of ``capacity`` rows is filled document by document; the document that
fills or overflows it keeps only what fits, and the next document opens a new
file. With per-document row counts n and start offsets B (exclusive prefix
sums over documents with rows), a file starting at offset b ends at the first
document whose end offset E = B + n reaches b + capacity, and the next file
starts at that E. So every offset has one successor, found for all offsets in one
sorted pass, and the file starts are what can be reached from 0: pointer doubling
marks them in log2(files) rounds of two joins on unique offsets. No job, driver entry
or plan literal belongs to a single file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.plans.numbering import nearest, prefix_sum


def _stored(df: DataFrame) -> DataFrame:
    from tokenmill.session import scratch_path

    path = scratch_path(df.sparkSession, "crop")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_starts(per_doc: DataFrame, capacity: int) -> DataFrame:
    """``start, file_no`` of every file, from a written ``B, E`` table."""
    offsets = per_doc.select(F.col("B").alias("b"), (F.col("B") + F.lit(capacity)).alias("q"))
    jump = _stored(nearest(offsets, "q", per_doc, "E", out="to").where("to IS NOT NULL").select("b", "to"))
    # the last document's end opens a file only if a document follows
    starts = _stored(per_doc.where("B = 0").select(F.lit(0).cast("long").alias("start"), F.lit(0).alias("file_no")))
    step = 1
    while True:
        further = starts.join(jump.withColumnRenamed("b", "start"), "start").select(F.col("to").alias("start"), (F.col("file_no") + step).alias("file_no"))
        further = _stored(further)
        if further.isEmpty():
            return starts
        starts = _stored(starts.unionByName(further))
        jump = _stored(jump.join(jump.select(F.col("b").alias("to"), F.col("to").alias("to2")), "to").select("b", F.col("to2").alias("to")))
        step *= 2


def crop_assignment(counts: DataFrame, capacity: int, doc_col: str = "doc_id", n_col: str = "n") -> DataFrame:
    """``doc_id, n, kept, file_no`` for every document with at least one row."""
    per_doc = prefix_sum(counts.filter(F.col(n_col) > 0), [doc_col], n_col, out="B")
    per_doc = _stored(per_doc.withColumn("E", F.col("B") + F.col(n_col)))
    starts = file_starts(per_doc, capacity)
    placed = nearest(per_doc, "B", starts, "start", out="start", forward=False).join(starts, "start")
    kept = F.least(F.col(n_col), F.col("start") + F.lit(capacity) - F.col("B")).cast("long")
    return placed.select(doc_col, n_col, kept.alias("kept"), F.col("file_no").cast("int").alias("file_no"))


def crop_rows(rows: DataFrame, assignment: DataFrame, doc_col: str = "doc_id", row_col: str = "row_no") -> DataFrame:
    """Keep the rows that fit (``row_no < kept``) and attach their file number."""
    a = assignment.select(doc_col, "kept", "file_no")
    return rows.join(a, doc_col).filter(F.col(row_col) < F.col("kept")).drop("kept")
