"""Spelling variants against all pairs."""

import re
import zlib
from collections import Counter

import pytest

from tests.llm.common import odd_documents, rng
from tokenmill.llm import spelling


def _words(rows, least, count):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= count}


def _near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def _brute(n):
    near = {w: [v for v in n if v != w and _near(v, w)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def _texts(seed):
    r = rng(seed)
    letters = "abÀéÿ×"
    stems = ["".join(r.choice(letters) for _ in range(r.randrange(1, 9))) for _ in range(40)]
    stems += [s[:k] + r.choice(letters) + s[k + r.randrange(2) :] for s in stems for k in (0, len(s) // 2, len(s))]
    texts = [" ".join(r.choice(stems[: 1 + r.randrange(len(stems))]) for _ in range(r.randrange(0, 150))) for _ in range(40)]
    return texts + [texts[0].upper(), "aaaaa aaaaaa aaaaaaa " * 4, "Zażółć gęślą×jaźń"]


@pytest.mark.parametrize("least,count", [(5, 3), (1, 1), (3, 2)])
def test_all_pairs(spark, least, count):
    df = odd_documents(spark, _texts(least), [(3, "again again again", "", "", 0), (None, "nobody's words " * 3, "", "", 0)])
    want = _brute(_words([(x.doc_id, x.text) for x in df.collect()], least, count))
    got = [tuple(x) for x in spelling.variants(df, least_length=least, least_count=count).collect()]
    assert len(got) == len(want) and set(got) == want


def test_long_words(spark):
    r = rng(8)
    long = "".join(r.choice("abcd") for _ in range(20_000))
    forms = [long, long[:9000] + long[9001:], long[:15_000] + "x" + long[15_001:], long + "q", "x" * 5000, "x" * 4999]
    words = spark.createDataFrame([(w,) for w in forms], "word string")
    got = {(x.a, x.b) for x in spelling.near_pairs(words, 5).collect()}
    assert got == {(a, b) for a in forms for b in forms if a != b and _near(a, b)}


def test_runs_longer_than_the_table_walk(spark):
    rows = [(i, f"{chr(97 + i % 26) * (60 + i % 9)} " * 3) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.word: x.n for x in spelling.word_counts(df).collect()} == _words(rows, 5, 3)


def test_empty_table(spark):
    df = odd_documents(spark, [])
    assert spelling.variants(df).count() == 0
    assert spelling.variants(df.limit(0)).count() == 0


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    """Only the offsets of a numbering (a row a partition) may go through the driver, however small Spark takes a table to be."""
    plans = []
    stored = spelling.stored
    monkeypatch.setattr(spelling, "stored", lambda df, name: plans.append(df) or stored(df, name))
    df = odd_documents(spark, _texts(5))
    plans.append(spelling.variants(df))
    joins = [line for p in plans for line in p._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) > 8
    assert [x for x in joins if "Broadcast" in x and "__pid" not in x] == []
