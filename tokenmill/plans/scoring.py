"""Scoring plans on the ``embeddings`` table (vectors with class labels)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.functions import arrays as A
from tokenmill.operators import scoring as S
from tokenmill.sources.readers import read_table


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings")


def scored(spark: SparkSession, sf_dir: str, held_out=None) -> DataFrame:
    """``vec_id, label, logits, probs, prediction, loss`` with the class-mean linear head.

    ``held_out`` adds a boolean column ``m`` to the vectors: the head is then fitted on the
    others, and only the held-out rows are scored.
    """
    emb = embeddings(spark, sf_dir)
    train = emb
    if held_out is not None:
        emb = held_out(emb)
        train, emb = emb.filter(~F.col("m")), emb.filter(F.col("m"))
    pred = S.predict_linear(emb, S.centroid_weights(train))
    return pred.withColumn("loss", A.cross_entropy("logits", "label"))
