"""The training-corpus pipeline: documents in, token ids out.

Stages, each over all rows that the one before kept:

1. toxicity: documents judged toxic go (models learnt from `labels` that are not held out);
2. near_duplicates: of each group of near copies (5-word shingles, similarity 0.8 or
   more) the document with the smallest doc_id stays, and of repeated rows one;
3. decontamination: documents that hold a 10-word window of `benchmark` go;
4. pii: personal data and secrets in the texts become surrogates, n_chars follows;
5. byte_bpe: token ids of every whole text, with a hash of the bytes they decode to.

All stages but the last return the columns of documents, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm import bpe, decontaminate, minhash, pii, toxicity
from tokenmill.llm.base import read, stored
from tokenmill.llm.queries import public_coder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, size=5, threshold=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_coder(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_pii),
    ("byte_bpe", encode),
]

#: DuckDB has neither the learnt models nor the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
