"""Chunked byte-level BPE against the library on whole texts."""

import hashlib
import random

import public_tokenizers
import pytest

from tokenmill.llm import bpe

TEXTS = [
    None,
    "",
    " ",
    "word",
    "It's we'll they're 'r 're don't  x\n\n  y\t z  ",
    "<|endoftext|> is text",
    "né à 中文没有空格的一段话 한국어 🙂🙂 ½ ٣٤ _under_score",
    "a" * 700,
    " " * 700 + "b",
    "x'" * 300,
    "\u0085   q" * 90,
]


@pytest.fixture(scope="module")
def coder(spark):
    return bpe.load(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def _random_text(rng, n):
    parts = ["'", "'r", "e", "re", " ", "  ", "\n", "abc", "Ünï", "12", "!?", "…", "中", "🙂", "\t", "'ll", "l", "s "]
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize("chunk,overlap", [(1, 4), (7, 8), (23, 16), (200, 64), (bpe.CHUNK, bpe.OVERLAP)])
def test_like_the_library(spark, coder, chunk, overlap):
    rng = random.Random(chunk)
    texts = TEXTS + [_random_text(rng, rng.randrange(1, 300)) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "word", "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, tuple(r.ids)) for r in bpe.encode(df, coder, chunk=chunk, overlap=overlap).collect()}
    lib = coder.value.library
    assert got == {(i, tuple(lib.encode_ordinary(t or ""))) for i, t, _ in rows}
    back = bpe.decode(bpe.encode(df, coder, chunk=chunk, overlap=overlap), coder).collect()
    assert len(back) == len(rows)
    assert sorted((r.doc_id or -1, bytes(r.bytes)) for r in back) == sorted((i or -1, (t or "").encode()) for i, t, _ in rows)
    for r in bpe.round_trip(df, coder, chunk=chunk, overlap=overlap).collect():
        if r.doc_id is not None:
            ids = lib.encode_ordinary(texts[r.doc_id] or "")
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_empty_table(spark, coder):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), coder).count() == 0
