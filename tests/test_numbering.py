"""Partition-offset numbering equals a global row_number / running sum, for any partitioning."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tokenmill.plans.numbering import index_by_order, prefix_sum


def test_index_matches_row_number(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(5), rnd.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, g int, v double")
    for parts in (1, 3, 16):
        got = {r.k: r.idx for r in index_by_order(df.repartition(parts), ["v", "k"], num_partitions=parts).collect()}
        want = {r.k: r.rn for r in df.select("k", (F.row_number().over(Window.orderBy("v", "k")) - 1).alias("rn")).collect()}
        assert got == want
        got_g = {r.k: r.idx for r in index_by_order(df, ["v", "k"], group_cols=["g"], num_partitions=parts).collect()}
        want_g = {
            r.k: r.rn
            for r in df.select("k", (F.row_number().over(Window.partitionBy("g").orderBy("v", "k")) - 1).alias("rn")).collect()
        }
        assert got_g == want_g


def test_prefix_sum_matches_running_sum(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randrange(3), rnd.randrange(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, g int, n long")
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    want = {r.k: r.s for r in df.select("k", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("s")).collect()}
    got = {r.k: r.start for r in prefix_sum(df, ["k"], "n", num_partitions=5).collect()}
    assert got == want
    wg = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    want_g = {r.k: r.s for r in df.select("k", F.coalesce(F.sum("n").over(wg), F.lit(0)).alias("s")).collect()}
    got_g = {r.k: r.start for r in prefix_sum(df, ["k"], "n", group_cols=["g"], num_partitions=4).collect()}
    assert got_g == want_g


def test_checkpoint_mode(spark):
    df = spark.range(0, 50).withColumnRenamed("id", "k")
    got = sorted((r.k, r.idx) for r in index_by_order(df, ["k"]).collect())
    assert got == [(i, i) for i in range(50)]


def test_prefix_sum_makes_its_input_once(spark):
    from tokenmill.plans.numbering import prefix_sum

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(0, 100, numPartitions=4).selectExpr("id", "id AS n").mapInArrow(counted, "id long, n long")
    out = {r.id: r.start for r in prefix_sum(df, ["id"], "n").collect()}
    assert out == {i: i * (i - 1) // 2 for i in range(100)}
    assert seen.value == 100
