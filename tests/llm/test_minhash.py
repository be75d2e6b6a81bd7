"""Near duplicates against all pairs."""

import re

import numpy as np
import pytest

from tests.llm.common import odd_documents, rng, text
from tokenmill.llm import bitmap, minhash


def _shingles(t, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def _brute(rows, size, threshold):
    sets = {i: _shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def _near(r, t, edits):
    w = t.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(999)}"
    return " ".join(w)


@pytest.mark.parametrize("size,threshold", [(3, 85), (5, 80)])
def test_all_pairs(spark, size, threshold):
    r = rng(size)
    base = [text(r, r.randrange(1, 160)) for _ in range(25)]
    texts = base + [_near(r, b, r.randrange(0, 6)) for b in base * 3] + ["One two", "one  two", "one", "one two three", "A " * 50, "a " * 60]
    df = odd_documents(spark, texts)
    want = _brute([(x.doc_id, x.text) for x in df.collect()], size, threshold)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(df, size=size, threshold=threshold).collect()}
    assert got == want
    kept = minhash.keep_one(df, size=size, threshold=threshold)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_a_group_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    r = rng(9)
    base = text(r, 120)
    texts = [_near(r, base, 1 + k % 5) for k in range(60)] + [base]
    df = odd_documents(spark, texts)
    want = _brute([(x.doc_id, x.text) for x in df.collect()], 3, 85)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(df, size=3, threshold=85).collect()}
    assert got == want


def test_odd_ids_and_empty_table(spark):
    df = odd_documents(spark, ["a b c d e f"], [(0, "a b c d e f", "k", "n", 0), (None, "a b c d e f", None, None, None)])
    got = minhash.near_duplicates(df).collect()
    assert len(got) == 6 and {x.kept for x in got} == {True}
    assert sorted((x.doc_id or -1) for x in minhash.keep_one(df).collect()) == [-1, -1, 1000, 1001, 1002]
    empty = df.limit(0)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one(empty).count() == 0


def test_bitmap_hash_is_sparks(spark):
    df = spark.range(-50, 50).selectExpr("id * 12345678901 AS v", "xxhash64(id * 12345678901) AS h")
    rows = df.collect()
    assert bitmap.xxhash64(np.array([r.v for r in rows])).view(np.int64).tolist() == [r.h for r in rows]
    bits = bitmap.build(df, "v", 100)
    assert bitmap.test(bits, np.array([r.v for r in rows])).all()


def test_one_id_with_two_texts_loses_nothing_unique(spark):
    r = rng(12)
    a, b = text(r, 60), " ".join(f"own{i}" for i in range(50))
    df = odd_documents(spark, [], [(1, a, "", "", 0), (2, a, "", "", 0), (2, b, "", "", 0), (2, b, "", "", 0), (3, a + " end", "", "", 0)])
    kept = sorted((x.doc_id, x.text) for x in minhash.keep_one(df).collect() if x.doc_id is not None and x.doc_id < 1000)
    assert kept == [(1, a), (2, b)]
