"""Byte-wise substring dedup against all windows, and the suffix order against sorted()."""

import hashlib

import numpy as np
import pytest

from tests.llm.common import odd_documents, rng, text
from tokenmill.llm import suffixes


def _brute(rows, size):
    docs = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, x in docs:
        for p in range(len(x) - size + 1):
            if i is not None:
                least[x[p : p + size]] = min(least.get(x[p : p + size], i), i)
    out = []
    for i, x in docs:
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - size + 1):
            if i is not None and least[x[p : p + size]] < i:
                gone[p : p + size] = True
        kept = bytes(c for c, g in zip(x, gone) if not g)
        spans = sum(bool(g) and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def _got(df, **more):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffixes.remove(df, **more).collect()), key=str)


@pytest.mark.parametrize("size,group", [(50, 10**6), (50, 2), (17, 1), (9, 10**6)])
def test_all_windows(spark, size, group):
    r = rng(size + group)
    passage = [text(r, r.randrange(4, 40)) for _ in range(4)]
    texts = [" ".join(r.choice([text(r, r.randrange(0, 30)), r.choice(passage)]) for _ in range(r.randrange(1, 5))) for _ in range(40)]
    texts += [texts[3], texts[3], "a" * 400, "a" * 300 + "b" * 60, "ab" * 100, passage[0] * 30]
    # one id with two texts: each is cut by its own windows only
    df = odd_documents(spark, texts, [(1, texts[5], "", "", 0), (2, texts[2], "", "", 0), (3, "no window of " + texts[9], "", "", 0), (None, texts[3], "", "", 0)])
    assert _got(df, size=size, group=group) == _brute([(x.doc_id, x.text) for x in df.collect()], size)


def test_partitions_do_not_matter_and_empty_table(spark):
    r = rng(5)
    df = odd_documents(spark, [text(r, 60) + " common tail of every text, long enough to repeat in all of them" for _ in range(30)])
    assert _got(df.repartition(1)) == _got(df.repartition(13))
    assert suffixes.remove(df.limit(0)).count() == 0


def test_long_text(spark):
    r = rng(6)
    long = text(r, 150_000)
    df = spark.createDataFrame([(1, long), (2, "head " + long[1000:600_000] + " tail of its own, which nobody has")], "doc_id long, text string")
    got = {x[0]: x for x in _got(df)}
    assert got[1][2] == 0 and got[2][3] == 1 and got[2][2] >= len(long[1000:600_000].encode())


@pytest.mark.parametrize("size", [8, 16, 20, 50])
def test_order_of_suffixes(size):
    r = np.random.default_rng(size)
    raw = r.integers(97, 99, 4000).astype(np.uint8)
    raw[1000:1300] = 97
    raw[2000:2500] = raw[500:1000]
    at = np.arange(len(raw) - size)
    group = r.integers(0, 3, len(at))
    order, head = suffixes.sort_suffixes(np.concatenate((raw, np.zeros(64 + size, np.uint8))), at, group, size)
    key = [(int(group[i]), raw[i : i + size].tobytes()) for i in at]
    assert [key[i] for i in order] == sorted(key)
    assert all((key[order[i]] == key[order[i - 1]]) == (head[i] == head[i - 1]) for i in range(1, len(order)))


def test_a_partition_larger_than_one_piece(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "SORTED", 50)
    r = rng(1)
    texts = [text(r, 12).encode() + b"p" * 30 for _ in range(40)]
    rows = [(7 if i < 30 else 8, i, 0, 0, len(t) - 19, t) for i, t in enumerate(texts + texts[:5])]
    batches = [pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows[i : i + 6]), suffixes._BYTES)], schema=suffixes._BYTES) for i in range(0, len(rows), 6)]
    got = set()
    for b in suffixes._repeats(20)(iter(batches)):
        for d, _, p, n in zip(*(c.to_pylist() for c in b.columns)):
            got |= {(d, p + k) for k in range(n)}
    want, seen = set(), {}
    for part, d, _, _, n, t in rows:
        for p in range(n):
            if seen.setdefault((part, t[p : p + 20]), d) < d:
                want.add((d, p))
    assert got == want
