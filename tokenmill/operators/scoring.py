"""Scoring: linear heads, batch prediction, losses, accuracy and label ranking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions import arrays as A
from tokenmill.session import scratch_path


def centroid_weights(df: DataFrame, vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """A linear head without bias whose class rows are the class means of the vectors.

    ``label, weights ARRAY<DOUBLE>`` (one row per class; bounded by the class count).
    Per-dimension sums are partial-aggregated map-side, so no vector list is collected.
    """
    exploded = df.select(label_col, F.posexplode(vec_col).alias("d", "x"))
    means = exploded.groupBy(label_col, "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(label_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("weights")
    )


def weight_matrix(weights: DataFrame, label_col: str = "label") -> Column:
    """All class rows as one ``ARRAY<ARRAY<DOUBLE>>`` scalar (class-count rows, a scalar subquery)."""
    return weights.agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(label_col).alias("k"), F.col("weights").alias("w")))), lambda s: s["w"])
    ).scalar()


def linear_logits(vec, matrix_col: str = "__W") -> Column:
    """logits[k] = sum_d W[k][d] * x[d] (explicit form of the head)."""
    vec = F.col(vec) if isinstance(vec, str) else vec
    return F.transform(
        F.col(matrix_col),
        lambda row: F.aggregate(F.zip_with(row, vec, lambda w, x: w * x.cast("double")), F.lit(0.0).cast("double"), lambda a, b: a + b),
    )


def predict_linear(df: DataFrame, weights: DataFrame, vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Adds ``logits, probs, prediction`` for every row (the class matrix is a scalar subquery)."""
    scored = df.withColumn("__W", weight_matrix(weights, label_col)).withColumn("logits", linear_logits(vec_col))
    return scored.drop("__W").withColumn("probs", A.softmax("logits")).withColumn("prediction", A.argmax("logits"))


def fit_linear_head(df: DataFrame, vec_col: str = "embedding", label_col: str = "label", max_iter: int = 1000, reg: float = 0.01, tol: float = 1e-8):
    """Multinomial logistic regression without intercept (a linear head trained with cross-entropy).

    With ``reg > 0`` the optimum is unique. A fit that has not converged after ``max_iter``
    iterations is an error, never returned silently.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = df.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"), F.col(label_col).cast("double").alias("label"))
    lr = LogisticRegression(family="multinomial", fitIntercept=False, maxIter=max_iter, regParam=reg, tol=tol, standardization=False)
    model = lr.fit(data)
    if model.summary.totalIterations >= max_iter:
        raise RuntimeError(f"the head has not converged in {max_iter} iterations")
    return model


def head_coefficients(spark, model) -> DataFrame:
    """``label, weights`` rows of a fitted head (class count x dimension; small)."""
    mat = model.coefficientMatrix.toArray()
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(mat)], "label INT, weights ARRAY<DOUBLE>")


def linear_predictor(weights: np.ndarray):
    """A model for ``batch_predict``: a linear head given by its class rows."""
    w = np.asarray(weights, dtype=np.float64)

    def make_predict_fn():
        return lambda x: x.astype(np.float64) @ w.T

    return make_predict_fn


def batch_predict(df: DataFrame, make_predict_fn, width: int, vec_col: str = "embedding", out: str = "logits", batch_size: int = 256) -> DataFrame:
    """Score rows in Arrow batches with the caller's model via ``predict_batch_udf``.

    ``make_predict_fn`` builds the model once per Python worker and returns a function
    from a float matrix (rows x ``width``) to one vector per row. Rows keep their
    identity, so no positional alignment is needed.
    """
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[width]])
    return df.withColumn(out, udf(F.col(vec_col).cast("array<float>")))


def frequent_ids(df: DataFrame, id_col: str, most: int, tracked: int = 20_000) -> DataFrame:
    """``hot``: at most ``most`` ids, the most frequent by a sketch that is added up in the tasks (one row a task is exchanged)."""
    return df.select(F.expr(f"approx_top_k(`{id_col}`, {int(most)}, {int(tracked)})").alias("t")).select(F.inline("t")).select(F.col("item").alias("hot"))


def gather_rows(df: DataFrame, id_col: str, table: DataFrame, key_col: str, hot: int = 1000) -> DataFrame:
    """Row of ``table`` for every id; ids without a row, and null ids, keep nulls, so nothing is lost.

    Padding and special tokens can be most of a column of ids. The ``hot`` most frequent ids
    and null meet their rows, one for each, in a broadcast of that many rows at most; only the
    other ids, each a small share of the table, are exchanged. The sketch decides where a row
    is joined, never what it is joined with. ``table`` has one row for a key.
    """
    name = "__hot"
    ids = frequent_ids(df, id_col, hot).where("hot IS NOT NULL").withColumnRenamed("hot", name)
    path = scratch_path(df.sparkSession, "hot-rows")
    # the ids with their rows, written once: both branches read the same ones
    known = F.broadcast(ids).join(table, F.col(name) == F.col(key_col), "left")
    nothing = df.sparkSession.createDataFrame([[None] * len(known.columns)], T.StructType([T.StructField(f.name, f.dataType) for f in known.schema]))
    known.unionByName(nothing).write.parquet(path)
    known = df.sparkSession.read.schema(known.schema).parquet(path)
    same = df[id_col].eqNullSafe(F.col(name))
    frequent = df.join(F.broadcast(known), same).drop(name)
    others = df.join(F.broadcast(known.select(name)), same, "left_anti").join(table, F.col(id_col) == F.col(key_col), "left")
    return frequent.unionByName(others)


def cross_entropy(df: DataFrame, logits_col: str = "logits", target_col: str = "label", out="loss") -> DataFrame:
    return df.withColumn(out, A.cross_entropy(logits_col, target_col))


def masked_loss(df: DataFrame, loss_col: str = "loss", mask_col: str = "m", group_cols=()) -> DataFrame:
    """sum(loss * mask) / sum(mask); null when the mask is empty."""
    m = F.col(mask_col).cast("double")
    num = F.sum(F.col(loss_col) * m)
    den = F.sum(m)
    expr = F.when(den > 0, num / den).alias("masked_loss")
    return df.groupBy(*group_cols).agg(expr) if group_cols else df.agg(expr)


def loss_accuracy(df: DataFrame, loss_col="loss", pred_col="prediction", label_col="label", group_cols=()) -> DataFrame:
    aggs = [F.avg(loss_col).alias("mean_loss"), F.avg((F.col(pred_col) == F.col(label_col)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")]
    return df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)


def rank_labels(probs, names: list[str], digits: int = 3) -> Column:
    """Labels by probability, highest first (ties keep label order), rounded half-to-even."""
    probs = F.col(probs) if isinstance(probs, str) else probs
    names_arr = F.array(*[F.lit(n) for n in names])
    items = F.transform(probs, lambda p, i: F.struct((-p).alias("neg"), i.alias("idx"), F.element_at(names_arr, i + 1).alias("label"), F.bround(p, digits).alias("p")))
    return F.transform(F.array_sort(items), lambda s: F.struct(s["label"].alias("label"), s["p"].alias("p")))
