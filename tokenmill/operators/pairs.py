"""Sentence-pair operators: pair sources, length filter, label maps, subsets, union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Label domain, in id order.
LABELS = ["neutral", "entailment", "contradiction"]
# Strings read as missing by the default TSV reader mode.
DEFAULT_NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def label_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LABELS)), "label_id INT, label STRING")


def label_encode(label) -> Column:
    """label string -> 0/1/2; unknown labels give null (checked by ``quality_report``)."""
    label = F.col(label) if isinstance(label, str) else label
    expr = None
    for i, name in enumerate(LABELS):
        expr = F.when(label == name, F.lit(i)) if expr is None else expr.when(label == name, F.lit(i))
    return expr


def label_decode(label_id) -> Column:
    label_id = F.col(label_id) if isinstance(label_id, str) else label_id
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), label_id + 1)


def label_join(df: DataFrame, id_col: str = "label_id", out: str = "label") -> DataFrame:
    """The same map as a broadcast left join against the 3-row label table."""
    labels = label_table(df.sparkSession).withColumnRenamed("label_id", "__lid").withColumnRenamed("label", out)
    return df.join(F.broadcast(labels), df[id_col] == labels["__lid"], "left").drop("__lid")


def length_filter(df: DataFrame, max_chars: int = 1000, cols=("sentence1", "sentence2")) -> DataFrame:
    """Both sentences shorter than ``max_chars`` characters; missing sentences are dropped."""
    cond = None
    for c in cols:
        ok = F.char_length(F.col(c)) < max_chars
        cond = ok if cond is None else cond & ok
    return df.filter(F.coalesce(cond, F.lit(False)))


def union_all(*frames: DataFrame) -> DataFrame:
    """Stack frames of one schema by column name, keeping duplicates."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """Unlabelled pairs: a user turn and the assistant turn right after it.

    ``conv_id, turn, sentence1, sentence2`` (an equi-join on (conv_id, turn + 1)).
    """
    users = conversations.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("sentence1")
    )
    replies = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sentence2")
    )
    return users.join(replies, ["conv_id", "turn"])


def document_pairs(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled pairs from labelled documents: every line with the next one, gold label from the label table.

    toxic -> contradiction, else quality 1 -> entailment, else neutral. ``doc_id, pair_no,
    sentence1, sentence2, gold_label``; a document of one line gives one pair with an empty
    second sentence.
    """
    lines = F.split(F.col("text"), "\n", -1)
    gold = (
        F.when(F.col("toxic") == 1, F.lit("contradiction"))
        .when(F.col("quality") == 1, F.lit("entailment"))
        .otherwise(F.lit("neutral"))
    )
    firsts = F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(1)))
    seconds = F.when(F.size(lines) > 1, F.slice(lines, 2, F.size(lines))).otherwise(F.array(F.lit("")))
    joined = documents.select("doc_id", "text").join(labels, "doc_id")
    pairs = joined.select("doc_id", gold.alias("gold_label"), F.posexplode(F.arrays_zip(firsts.alias("a"), seconds.alias("b"))).alias("pair_no", "p"))
    return pairs.select("doc_id", "pair_no", F.col("p.a").alias("sentence1"), F.col("p.b").alias("sentence2"), "gold_label")
