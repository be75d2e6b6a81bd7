"""Many small files written by tasks hold what Spark's writers put into theirs."""

import os

from pyspark.sql import functions as F

from tokenmill.session import scratch_path
from tokenmill.sources import sinks, small_files
from tokenmill.sources.readers import scan_text_corpus

TEXTS = [(1, "a\nb"), (-7, "é 中"), (12, None), (13, ""), (1, "a\nb"), (2**40, "x"), (None, "nobody's")]


def _left(path):
    return sorted(n for _, _, names in os.walk(path.removeprefix("file://")) for n in names)


def _texts(spark, path):
    with small_files.reading_many(spark):
        found = scan_text_corpus(spark, path).select(F.regexp_extract("path", "doc_id=([^/]*)/[^/]*$", 1), "text").collect()
    return sorted(map(tuple, found))


def test_texts_as_sparks_writer_writes_them(spark, monkeypatch):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    path = scratch_path(spark, "texts")
    sinks.write_texts(df, path, "doc_id", "text")
    assert len(_left(path)) == 6 and all(n.endswith(".txt") for n in _left(path))  # one a doc_id, no checksum files: no process was started for each
    monkeypatch.setattr(small_files, "can_write", lambda *_: None)
    plain = scratch_path(spark, "texts")
    sinks.write_texts(df, plain, "doc_id", "text")
    assert len(_left(plain)) > 6
    want = _texts(spark, plain)
    assert _texts(spark, path) == want and len(want) == 6 and ("1", "a\nb\na\nb\n") in want and ("12", "\n") in want


def test_no_texts(spark):
    path = scratch_path(spark, "texts")
    sinks.write_texts(spark.createDataFrame([], "doc_id long, text string"), path, "doc_id", "text")
    assert _texts(spark, path) == []


def test_shards_as_sparks_writer_writes_them(spark, monkeypatch):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), (F.col("id") % 7).cast("int").alias("row_no"), F.array(F.col("id").cast("int"), F.lit(None).cast("int")).alias("input"),
        F.array(F.col("id") % 2 == 0, F.lit(True)).alias("mask"), (F.col("id") % 5).cast("int").alias("shard"), (F.xxhash64("id") % 1000 / 2000 + 0.5).alias("h"),
    )

    def read(path):
        with small_files.reading_many(spark):
            back = spark.read.schema("doc_id long, row_no int, input array<int>, mask array<boolean>, h double, shard int, bucket int").parquet(path)
            return sorted(map(tuple, back.select("shard", "bucket", F.col("_metadata.row_index"), "doc_id", "row_no", "input", "mask", "h").collect()))

    path, plain = scratch_path(spark, "shards"), scratch_path(spark, "shards")
    for _ in range(2):  # a second time over the first
        assert sinks.write_shards(df, path, num_shards=5, rows_per_file=100) == 6
    assert all(n.startswith("part-") for n in _left(path))
    monkeypatch.setattr(small_files, "can_write", lambda *_: None)
    sinks.write_shards(df, plain, num_shards=5, rows_per_file=100)
    assert len(_left(plain)) > len(_left(path)) >= 30
    assert read(path) == read(plain)


def test_keys_that_need_escaping_are_left_to_spark(spark):
    df = spark.createDataFrame([("a/b", "x")], "doc_id string, text string")
    assert small_files.can_write(df, scratch_path(spark, "texts"), ["doc_id"]) is None


def test_settings_come_back(spark):
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    with small_files.reading_many(spark):
        assert spark.conf.get("spark.sql.files.openCostInBytes") != before
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
