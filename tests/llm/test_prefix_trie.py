"""Conversation trie against a plain one, and the list ranking against a walk."""

import hashlib
import random
import re
import zlib

import pytest

from tokenmill.llm import prefix_trie


def _brute(rows):
    conv = {}
    for c, t, role, text in rows:
        if c is not None:
            conv.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    conv = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in conv.items()}
    seqs = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c > 0 else -1)
        seqs[c] = conv.get(base, [])[:h] + own[h:]
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
    out = set()
    for n, members in nodes.items():
        below = [m for m in nodes if m[: len(n)] == n]
        kids = [m for m in below if len(m) == len(n) + 1]
        leaves = sum(not any(x[: len(m)] == m and len(x) > len(m) for x in nodes) for m in below)
        saved = sum((len(nodes[m]) - 1) * words(m) for m in below)
        ends = ",".join(map(str, sorted(c for c in members if len(seqs[c]) == len(n))))
        out.add((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _rows(seed):
    r = random.Random(seed)
    say = ["hi", "hello there", "", None, "a  b\tc", "ünï cödé"]
    rows = []
    for c in [*range(-25, 70), 400, 401, 10**12 + 7]:
        for _ in range(r.randrange(1, 6)):
            rows.append((c, r.choice([None, 0, 1, 1, 2, 3]), r.choice(["user", "assistant", None]), r.choice(say)))
    return rows + rows[:5] + [(None, 0, "user", "nobody"), (500, 1, "user", "hi")] * 2


@pytest.mark.parametrize("base,block", [(1 << 16, 4096), (4, 4)])
def test_like_a_plain_trie(spark, monkeypatch, base, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "PIECE", 8)
    rows = _rows(base)
    df = spark.createDataFrame([(*x, "extra", 1) for x in rows], "conv_id long, turn long, role string, text string, key string, depth long")
    turns, ids = prefix_trie.with_openings(prefix_trie.ordered(df))
    got = prefix_trie.trie(turns, ids, base=base, block=block).collect()
    want = _brute(rows)
    assert len(got) == len(want)
    assert {tuple(x) for x in got} == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(*prefix_trie.with_openings(prefix_trie.ordered(df))).count() == 0


def test_one_long_conversation(spark):
    rows = [(40, i, "user", f"turn {i // 2}") for i in range(9000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.depth: x for x in prefix_trie.trie(*prefix_trie.with_openings(prefix_trie.ordered(df))).collect()}
    assert len(got) == 9001 and {x.n_leaves for x in got.values()} == {1}


def test_list_ranks(spark):
    order = list(range(300))
    random.Random(3).shuffle(order)
    df = spark.createDataFrame(list(zip(order, order[1:] + [None])), "arc long, next long")
    got = {x.arc: x.pos for x in prefix_trie.list_ranks(df, base=5).collect()}
    assert got == {a: i for i, a in enumerate(order)}


def test_many_ids_on_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 100)
    rows = [(1, 2, 3, i) for i in range(60_000)] + [(5, i % 50, 1, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k1 long, k2 long, depth long, conv_id long").repartition(7)
    got = {(x.k1, x.k2): x.sha for x in prefix_trie.ends_hash(df).collect()}
    ids = {}
    for a, b, _, i in rows:
        ids.setdefault((a, b), []).append(i)
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in ids.items()}
