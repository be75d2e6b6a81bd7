"""The pipeline stage by stage: decisions take effect, columns stay."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tokenmill.llm import bpe, decontaminate, minhash, pii, toxicity
from tokenmill.llm.base import stored

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("count", F.lit(1)).withColumn("raw", F.col("lang"))
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(stored(f(spark, out[-1], SF), "test-stage"))
    return out


def test_stages(spark, stages):
    docs, mild, single, clean, safe, coded = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "byte_bpe"]
    assert all(s.columns == docs.columns for s in stages[1:-1])
    ids = [sorted(r.doc_id for r in s.select("doc_id").collect()) for s in stages]
    toxic = {r.doc_id for r in toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert ids[1] == [i for i in ids[0] if i not in toxic] and toxic
    assert ids[2] == sorted(r.doc_id for r in minhash.near_duplicates(mild).where("kept").collect()) and len(ids[2]) < len(ids[1])
    hit = {r.doc_id for r in decontaminate.digest(decontaminate.find(single, spark.read.parquet(f"{SF}/benchmark.parquet"))).where("contaminated").collect()}
    assert ids[3] == [i for i in ids[2] if i not in hit] and hit
    assert ids[4] == ids[5] == ids[3]
    before = {r.doc_id: r.text for r in clean.collect()}
    changed = [r for r in safe.collect() if r.text != before[r.doc_id]]
    assert changed and all(r.n_chars == len(r.text) for r in safe.collect())
    found = {(r.type, r.canon) for r in pii.occurrences(clean).collect()}
    assert not found & {(r.type, r.canon) for r in pii.occurrences(safe).collect()}
    library = bpe.load(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).value.library
    texts = {r.doc_id: r.text for r in safe.collect()}
    for r in coded.collect():
        tokens = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(tokens) and r.ids_sha256 == hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
    assert docs.count() == 0
