"""Numbered files over a stream: several arrivals, restarts, several writers, a batch that is repeated."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tokenmill.operators.crop import crop_assignment
from tokenmill.plans import corpus as C
from tokenmill.sources.sinks import number_files
from tokenmill.streaming.pack import run_stream_files

SF_SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("crop", [False, True])
def test_files_over_restarts(spark, small_ctx, tmp_path, crop):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    source, staged, sink, ckpt = (str(tmp_path / x) for x in ("source", "staged", "sink", "ckpt"))
    bounds = docs.selectExpr("percentile_approx(doc_id, array(0.3, 0.35, 1.0))").first()[0]
    low = -1
    for k, high in enumerate(bounds):
        docs.where(f"doc_id > {low} AND doc_id <= {high}").repartition(2).write.mode("append").parquet(source)
        low = high
        run_stream_files(spark, source, staged, sink, ckpt, small_ctx, 50, crop)
        if k == 1:
            # the last batch was not committed: it is run again and replaces its own files
            last = max(int(p.rsplit("/", 1)[-1]) for p in glob.glob(f"{ckpt}/files/commits/[0-9]*"))
            for name in (f"{last}", f".{last}.crc"):
                os.remove(f"{ckpt}/files/commits/{name}")
            run_stream_files(spark, source, staged, sink, ckpt, small_ctx, 50, crop)
    back = spark.read.option("basePath", sink).parquet(f"{sink}/batch=*")
    got = {(r.doc_id, r.row_no): (int(r.file_no), r.tokens) for r in back.select("doc_id", "row_no", "file_no", "tokens").collect()}
    assert back.count() == len(got) and len({b for b in back.select("batch").distinct().collect()}) == 3
    rows = C.raw_sequences(small_ctx).select("doc_id", "row_no", "tokens")
    if crop:
        places = crop_assignment(rows.groupBy("doc_id").agg(F.count("*").alias("n")), 50)
        want = rows.join(places, "doc_id").where("row_no < kept")
    else:
        want = number_files(rows, 50)
    assert got == {(r.doc_id, r.row_no): (r.file_no, r.tokens) for r in want.collect()}


def test_writers_side_by_side(spark, small_ctx, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    source, staged, sink, ckpt = (str(tmp_path / x) for x in ("source", "staged", "sink", "ckpt"))
    docs.write.parquet(source)
    run_stream_files(spark, source, staged, sink, ckpt, small_ctx, 20, writer_col="lang")
    back = spark.read.option("basePath", sink).parquet(f"{sink}/batch=*")
    full = back.groupBy("writer", "file_no").agg(F.count("*").alias("n"), F.countDistinct("place").alias("p")).collect()
    assert all(r.n == r.p for r in full) and len({r.writer for r in full}) == docs.select("lang").distinct().count()
    assert sum(r.n < 20 for r in full) <= len({r.writer for r in full})
    assert back.count() == C.raw_sequences(small_ctx).count()
