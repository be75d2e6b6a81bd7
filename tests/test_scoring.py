"""Loss, softmax, argmax, label ranking."""

import math

from pyspark.sql import functions as F

from tokenmill.functions import arrays as A
from tokenmill.operators.scoring import frequent_ids, gather_rows, masked_loss, rank_labels

# confident and wrong, confident and right, level, level and shifted
LOGITS = [[60.0, -3.0, 1.0], [-20.0, 4.0, 90.0], [0.5, 0.5, 0.5], [-31.0, -31.0, -31.0]]
TARGET = [1, 2, 0, 1]


def _frame(spark):
    return spark.createDataFrame(list(zip(range(4), LOGITS, TARGET)), "i int, logits array<double>, t int")


def test_cross_entropy_properties(spark):
    rows = _frame(spark).select("i", A.cross_entropy("logits", "t").alias("ce")).orderBy("i").collect()
    ce = [r.ce for r in rows]
    assert ce[0] > ce[2] > ce[1]  # wrong confident > uniform > right confident
    assert abs(ce[1]) < 1e-10  # exact zero for a confident right answer
    assert abs(ce[2] - math.log(3)) < 1e-12 and abs(ce[3] - math.log(3)) < 1e-12  # shift invariance


def test_softmax_and_log_softmax(spark):
    rows = _frame(spark).select(A.softmax("logits").alias("p"), A.log_softmax("logits").alias("lp")).collect()
    for r in rows:
        assert abs(sum(r.p) - 1) < 1e-12
        assert all(abs(math.exp(a) - b) < 1e-12 for a, b in zip(r.lp, r.p))


def test_argmax_first_on_tie_and_one_hot(spark):
    rows = _frame(spark).select(A.argmax("logits").alias("a"), A.one_hot("t", 3).alias("oh")).collect()
    assert [r.a for r in rows] == [0, 2, 0, 0]
    assert rows[0].oh == [0.0, 1.0, 0.0]


def test_masked_loss_ignores_masked_rows(spark):
    df = spark.createDataFrame([(1.0, 1), (3.0, 1), (100.0, 0)], "loss double, m int")
    assert masked_loss(df, "loss", "m").first()[0] == 2.0
    empty = spark.createDataFrame([(1.0, 0)], "loss double, m int")
    assert masked_loss(empty, "loss", "m").first()[0] is None


def test_rank_labels_ties_keep_label_order(spark):
    df = spark.createDataFrame([([0.25, 0.5, 0.25],)], "p array<double>")
    r = df.select(rank_labels("p", ["neutral", "entailment", "contradiction"]).alias("r")).first().r
    assert [x.label for x in r] == ["entailment", "neutral", "contradiction"]
    # exactly representable ties round half to even, as Python's round does
    ties = [0.0625, 0.1875, 0.3125, 0.4375]
    half = spark.createDataFrame([(t,) for t in ties], "x double").select(A.round_half_even("x", 3).alias("y")).collect()
    assert [float(h.y) for h in half] == [round(t, 3) for t in ties]


def test_vector_functions_evaluate_totals_once(spark):
    wide = spark.range(200).select(F.transform(F.sequence(F.lit(1), F.lit(768)), lambda i: (i * F.col("id") % 7).cast("double")).alias("x"), (F.col("id") % 768).cast("int").alias("t"))
    r = wide.select(F.max(F.abs(F.aggregate(A.softmax("x"), F.lit(0.0), lambda a, v: a + v) - 1)).alias("p"), F.sum(A.cross_entropy("x", "t")).alias("c")).first()
    assert r.p < 1e-9 and r.c > 0


def test_gather_rows_hot_ids(spark):
    """Hot ids, null ids, ids without a row: every id keeps its row; the frequent ones are not exchanged."""
    ids = [0] * 4000 + [None] * 900 + [7] * 500 + [999] * 300 + list(range(200)) * 2
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, n long")
    table = spark.range(150).select(F.col("id").alias("key"), F.array(F.col("id") * 2, F.col("id")).alias("vec"))
    for hot in (1, 3, 1000):
        out = gather_rows(df, "id", table, "key", hot=hot)
        got = sorted((r.n, r.id, r.key, r.vec) for r in out.collect())
        assert got == [(k, i, i if i is not None and i < 150 else None, [2 * i, i] if i is not None and i < 150 else None) for k, i in enumerate(ids)]
    assert gather_rows(df.limit(0), "id", table, "key").count() == 0 and gather_rows(df, "id", table.limit(0), "key").where("vec IS NULL").count() == len(ids)


def test_gather_rows_evens_out_tasks(spark):
    """With the table above the broadcast limit, no task of the exchange reads more than twice the median."""
    df = spark.range(200_000).select(F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id") % 4096).alias("id"))
    table = spark.range(4096).select(F.col("id").alias("key"), F.col("id").alias("vec"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        cold = df.join(frequent_ids(df, "id", 100), F.col("id") == F.col("hot"), "left_anti")
        sizes = sorted(r["count"] for r in cold.groupBy(F.pmod(F.hash("id"), F.lit(8)).alias("p")).count().collect())
        assert sizes[-1] <= 2 * sizes[4] and sum(sizes) < 70_000
        plan = gather_rows(df, "id", table, "key")._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
        assert gather_rows(df, "id", table, "key").where("vec = id").count() == 200_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
