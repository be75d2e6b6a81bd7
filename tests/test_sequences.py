"""Id halves, packing, chunking, key masks, batches (unit tests on small inline frames)."""

from tokenmill.operators import sequences as S


def test_id_round_trip(spark):
    ids = [0, 1, -1, -70_000, 65_535, 65_536, 2**31 - 1, 987_654_321]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    out = df.select("doc_id", S.encode_id_hi("doc_id").alias("hi"), S.encode_id_lo("doc_id").alias("lo"))
    out = out.select("doc_id", "hi", "lo", S.decode_id("hi", "lo").alias("back")).collect()
    for r in out:
        assert r.back == r.doc_id
        assert r.hi == r.doc_id >> 16 and r.lo == r.doc_id & 0xFFFF


def test_chunks_drop_remainder_and_short_documents(spark):
    df = spark.createDataFrame([(1, list(range(1, 8))), (2, [5, 6]), (3, [])], "doc_id long, ids array<int>")
    rows = S.chunk_sequences(df, "ids", 3).orderBy("doc_id", "row_no").collect()
    assert [(r.doc_id, r.row_no, r.tokens) for r in rows] == [(1, 0, [1, 2, 3]), (1, 1, [4, 5, 6])]


def test_pack_unpack_round_trip(spark):
    rows = [(7, 0, [3, 4, 5], [3, 9, 5], [False, True, False])]
    df = spark.createDataFrame(rows, "doc_id long, row_no int, target array<int>, input array<int>, mask array<boolean>")
    df = S.pack(df)
    flat = df.select(S.flat_row().alias("row"))
    assert flat.first().row[:3] == [0, 7, 0]
    assert len(flat.first().row) == 3 + 3 * 3
    parts = S.unpack_row("row", 3)
    back = flat.select(*[v.alias(k) for k, v in parts.items()]).first()
    assert back.input == [3, 9, 5] and back.target == [3, 4, 5] and back.mask == [False, True, False]
    assert back.meta == [0, 7, 0]


def test_key_mask_padding(spark):
    df = spark.createDataFrame([([1] * 10,), ([1] * 5 + [0] * 5,)], "ids array<int>")
    rows = df.select(S.key_mask("ids", 0).alias("m")).collect()
    assert rows[0].m == [True] * 10
    assert rows[1].m == [True] * 5 + [False] * 5


def test_batches_drop_last_and_keep(spark):
    df = spark.range(0, 33).withColumnRenamed("id", "k")
    dropped = S.batches(df, ["k"], 10, drop_last=True).collect()
    assert len(dropped) == 30 and max(r.batch_no for r in dropped) == 2
    kept = S.batches(df, ["k"], 10, drop_last=False).collect()
    assert len(kept) == 33 and {r.k: r.batch_no for r in kept}[32] == 3


def test_masked_positions(spark):
    df = spark.createDataFrame([(1, 0, [5, 6, 7], [False, True, True])], "doc_id long, row_no int, target array<int>, mask array<boolean>")
    rows = S.masked_positions(df).orderBy("pos").collect()
    assert [(r.pos, r.target) for r in rows] == [(1, 6), (2, 7)]


def test_zero_rows_are_detected(spark):
    from tokenmill.operators.checks import assert_no_zero_chunks, zero_row_report

    ok = spark.createDataFrame([(1, [0, 0, 1]), (2, [-1, 0, 0])], "doc_id long, row array<int>")
    assert_no_zero_chunks(ok)
    bad = spark.createDataFrame([(1, [0, 0, 0]), (2, [0, 1, 0]), (2, [0, 0, 0])], "doc_id long, row array<int>")
    rep = zero_row_report(bad).first()
    assert rep.zero_rows == 2 and rep.zero_chunks == 1
    import pytest

    with pytest.raises(ValueError):
        assert_no_zero_chunks(bad)
    with pytest.raises(ValueError):
        assert_no_zero_chunks(bad, mode="row")


def test_range_check(spark):
    import pytest

    from tokenmill.operators.checks import assert_in_range

    df = spark.createDataFrame([([1, 70000],)], "t array<int>")
    with pytest.raises(ValueError):
        assert_in_range(df, "t", 0, 65535)


def test_crop_mode_boundaries(spark):
    from tokenmill.operators.crop import crop_assignment, crop_rows

    counts = spark.createDataFrame([(0, 4), (1, 7), (2, 3), (3, 12), (4, 5), (5, 0)], "doc_id long, n long")
    got = {r.doc_id: (r.kept, r.file_no) for r in crop_assignment(counts, 10).collect()}
    assert got == {0: (4, 0), 1: (6, 0), 2: (3, 1), 3: (7, 1), 4: (5, 2)}
    rows = spark.createDataFrame([(d, r) for d, n in [(0, 4), (1, 7)] for r in range(n)], "doc_id long, row_no int")
    kept = crop_rows(rows, crop_assignment(counts, 10))
    assert kept.filter("doc_id = 1").count() == 6
    exact = spark.createDataFrame([(0, 10), (1, 3)], "doc_id long, n long")
    assert {r.doc_id: r.file_no for r in crop_assignment(exact, 10).collect()} == {0: 0, 1: 1}


def test_batches_need_one_full_batch(spark):
    import pytest

    df = spark.range(0, 9).withColumnRenamed("id", "k")
    with pytest.raises(ValueError):
        S.batches(df, ["k"], 10, drop_last=True)
    assert S.batches(df, ["k"], 10, drop_last=False).count() == 9
