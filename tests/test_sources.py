"""Sources and sinks with fixture files written by the tests (temporary folders)."""

import os

import numpy as np
from pyspark.sql import functions as F

from tokenmill.functions.text import paragraph_filter
from tokenmill.operators.checks import dataset_size
from tokenmill.sources import readers as R
from tokenmill.sources import sinks as K


def test_text_corpus_one_document_per_file(spark, tmp_path):
    for name, body in [("b/2.txt", "x\r\n\r\nsecond book paragraph that is long"), ("a/1.txt", "first book paragraph, long enough\n\nshort")]:
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body.encode())
    files = R.scan_text_corpus(spark, str(tmp_path / "*" / "*.txt"))
    docs = R.assign_doc_ids(files).select("doc_id", paragraph_filter("text").alias("text")).orderBy("doc_id").collect()
    assert [(d.doc_id, d.text) for d in docs] == [(0, "first book paragraph, long enough"), (1, "second book paragraph that is long")]


def test_pair_tsv_na_modes(spark, tmp_path):
    path = tmp_path / "train.tsv"
    path.write_text(
        "index\tsentence1\tsentence2\tgold_label\textra\n"
        "0\tA man walks.\tA person moves.\tentailment\tx\n"
        "1\tNA\tSomething.\tneutral\tx\n"
        "2\t" + "w" * 1000 + "\tshort\tcontradiction\tx\n"
    )
    train = R.scan_pair_tsv(spark, str(path))
    rows = train.collect()
    assert len(rows) == 3 and rows[1].sentence1 is None
    from tokenmill.operators.pairs import length_filter

    assert length_filter(train).count() == 1
    evaluation = R.scan_pair_tsv(spark, str(path), ("index", "sentence1", "sentence2"), default_na=False, types={"index": "int"})
    assert evaluation.orderBy("index").collect()[1].sentence1 == "NA"


def test_packed_binary_and_dataset_size(spark, tmp_path):
    rows = np.zeros((10, 3), dtype=np.uint16)
    rows[:5] = [[0, 7, i] for i in range(5)]
    rows[4] = [0, 0, 0]  # an all-zero data row would be treated as padding by a size scan; we keep rows
    rows[3] = [65535, 1, 2]
    (tmp_path / "0.npy").write_bytes(rows.tobytes())
    df = R.scan_packed_binary(spark, str(tmp_path / "0.npy"), 3)
    assert df.count() == 10
    assert dataset_size(df, "row") == 4
    assert sorted(r.row[0] for r in df.collect())[-1] == 65535


def test_numbered_files_rotation(spark, tmp_path):
    df = spark.createDataFrame([(v, 0) for v in range(1, 95)], "doc_id long, row_no int")
    out = str(tmp_path / "raw")
    K.write_packed(df, out, 10)
    back = spark.read.parquet(out)
    files = back.groupBy("file_no").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
    got = {r.file_no: (r.lo, r.hi, r.n) for r in files.collect()}
    assert len(got) == 10 and got[8] == (81, 90, 10) and got[9] == (91, 94, 4)


def test_shards_hold_rows_in_hash_order(spark, tmp_path):
    from tokenmill.operators.shards import assign_shard, shuffle_key

    df = spark.createDataFrame([(d, r) for d in range(50) for r in range(4)], "doc_id long, row_no int")
    keyed = shuffle_key(assign_shard(df, 5))
    out = str(tmp_path / "shards")
    assert K.write_shards(keyed, out, num_shards=5, rows_per_file=14) == 3  # buckets of a shard
    back = spark.read.parquet(out)
    assert back.count() == 200
    counts = {r.shard: r.n for r in back.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert counts == {r.shard: r.n for r in keyed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    # within a shard: bucket folders in order, files sorted by h
    shard_dir = os.path.join(out, "shard=0")
    hs = []
    for bucket in sorted(os.listdir(shard_dir), key=lambda b: int(b.split("=")[1]) if "=" in b else -1):
        if not bucket.startswith("bucket="):
            continue
        part = spark.read.parquet(os.path.join(shard_dir, bucket)).select("h").collect()
        hs.extend(r.h for r in part)
    assert hs == sorted(hs)


def test_predictions_and_vocab_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "neutral", "matched"), (1, "entailment", "mismatched")], "index long, prediction string, subset string")
    K.write_predictions(df, str(tmp_path / "pred"))
    files = [f for f in os.listdir(tmp_path / "pred" / "subset=matched") if f.endswith(".csv")]
    content = "".join((tmp_path / "pred" / "subset=matched" / f).read_text() for f in files)
    assert content == "0\tneutral\n"
    back = K.read_predictions(spark, str(tmp_path / "pred"))
    assert back.count() == 2


def test_packed_binary_round_trip_by_byte_ranges(spark, tmp_path, monkeypatch):
    rows = [(d, r, [d, r, 65535 - d, 1]) for d in range(40) for r in range(d % 5)]
    df = spark.createDataFrame(rows, "doc_id long, row_no int, row array<long>").repartition(7)
    out = str(tmp_path / "packed")
    K.write_packed_binary(df, out, rows_per_file=11, row_len=4)
    names = sorted(os.listdir(out))
    assert names == sorted(f"{i}.npy" for i in range(-(-len(rows) // 11)))
    flat = np.concatenate([np.fromfile(f"{out}/{i}.npy", "<u2").reshape(-1, 4) for i in range(len(names))])
    want = [r for _, _, r in sorted(rows)]
    assert flat[: len(rows)].tolist() == want and not flat[len(rows) :].any() and len(flat) % 11 == 0
    back = [r.row for r in R.scan_packed_binary(spark, out, 4).collect() if any(r.row)]
    assert sorted(back) == sorted(want)
    from tokenmill.sources import packed_rows

    monkeypatch.setattr(packed_rows, "RANGE_BYTES", 24)
    parts = packed_rows.Reader(out, 4, "<u2").partitions()
    assert len(parts) == 4 * len(names) and max(p.end - p.start for p in parts) == 24


def test_records_with_line_breaks_across_many_splits(spark, tmp_path):
    import csv
    import io
    import random

    r = random.Random(4)
    bits = ["a b", 'say "hi"', "two\nlines", "tab\there", "crlf\r\nin it", "", "x" * 30, '"', "\n\n", "ends\n"]
    rows = [(i, r.choice(bits) + r.choice(bits), r.choice(bits), r.choice(["neutral", "NA"])) for i in range(300)]
    buf = io.StringIO()
    w = csv.writer(buf, delimiter="\t", lineterminator="\n")
    w.writerow(["index", "sentence1", "sentence2", "gold_label"])
    w.writerows(rows)
    buf.write('300\tstray " quote inside\tit is 5" long\tneutral\n')
    (tmp_path / "a.tsv").write_bytes(buf.getvalue().encode())
    rows.append((300, 'stray " quote inside', 'it is 5" long', "neutral"))
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("70", "977", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            df = R.scan_pair_tsv(spark, str(tmp_path / "a.tsv"), ("index", "sentence1", "sentence2", "gold_label"), default_na=False, types={"index": "int"})
            got = sorted(tuple(x) for x in df.collect())
            assert [(a, (b or ""), (c or ""), d) for a, b, c, d in got] == sorted(rows)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_text_corpus_of_a_folder_is_that_of_its_pattern(spark, tmp_path):
    from tokenmill.sources.readers import scan_text_corpus

    for k in range(5):
        (tmp_path / f"d={k}").mkdir()
        (tmp_path / f"d={k}" / f"b{k}.txt").write_text(f"text {k}\nsecond line\n")
        (tmp_path / f"d={k}" / "notes.md").write_text("no book")
    one, other = (sorted(map(tuple, scan_text_corpus(spark, p).collect())) for p in (f"{tmp_path}", f"{tmp_path}/*/*.txt"))
    assert one == other and len(one) == 5


def test_small_shard_files_are_written_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from tokenmill.operators.shards import assign_shard, shuffle_key
    from tokenmill.sources.sinks import write_shards

    rows = shuffle_key(assign_shard(spark.range(400).select(F.col("id").alias("doc_id"), F.lit(0).alias("row_no")), 20))
    write_shards(rows, str(tmp_path / "s"), num_shards=20, rows_per_file=2, total_rows=400)
    back = spark.read.parquet(str(tmp_path / "s"))
    tasks = back.select(F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).alias("t")).distinct().count()
    assert back.count() == 400 and tasks > 8
