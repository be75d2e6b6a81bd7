"""Decontamination against all windows, one block of the benchmark or several."""

import hashlib
import re

import pytest

from tests.llm.common import odd_documents, rng, text
from tokenmill.llm import decontaminate


def _words(t):
    low = (t or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _brute(docs, items, size):
    out = {}
    for i, t in docs:
        w, hit, ids = _words(t), set(), set()
        for item, it in items:
            iw = _words(it)
            n = min(size, len(iw))
            if not n:
                continue
            wins = {tuple(iw[p : p + n]) for p in range(len(iw) - n + 1)}
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    ids |= {str(item)} - {"None"}
        out[i] = (len(w), len(hit), sorted(ids))
    return out


@pytest.mark.parametrize("block", [1 << 25, 400])
def test_all_windows(spark, block):
    r = rng(4)
    items = [(k, text(r, r.randrange(10, 30))) for k in range(30)] + [(100, "Rare pair"), (101, ""), (102, None), (7, "again " * 12), (None, "the of"), (103, "the " * 25)]
    texts = [" ".join(r.choice([text(r, r.randrange(0, 30)), (r.choice(items)[1] or "").upper()]) for _ in range(4)) for _ in range(60)] + ["rare, PAIR!", "the " * 40, "again " * 30]
    df = odd_documents(spark, texts)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = _brute([(x.doc_id, x.text) for x in df.collect()], items, 10)
    found = decontaminate.find(df, bench, block_bytes=block)
    got = {x.doc_id: (x.n_words, sum(b - a for a, b in x.spans), sorted(x["items"])) for x in found.collect()}
    assert got == want
    clean = decontaminate.remove(df, bench)
    assert clean.columns == df.columns
    assert sorted(x.doc_id for x in clean.collect()) == sorted(i for i, (_, n, _) in want.items() if not n)


@pytest.mark.parametrize("block", [1 << 25, 60])
def test_repeated_items_count_once(spark, block):
    """Two rows of one id, both found in a document; one block of the benchmark or several."""
    rows = [("x", "one two three four five six seven eight nine ten"), ("x", "red green blue black white grey pink brown gold tan"), ("y", "one two three four five six seven eight nine ten"), ("x", "one two three four five six seven eight nine ten")]
    bench = spark.createDataFrame(rows, "item_id string, text string")
    df = odd_documents(spark, [f"{rows[0][1]} and {rows[1][1]}"])
    found = decontaminate.find(df, bench, block_bytes=block).where("doc_id = 0")
    assert found.collect()[0]["items"] == ["x", "y"]
    got = decontaminate.digest(found).collect()[0]
    assert got.n_items == 2 and got.n_hit == 20 and got.items_sha256 == hashlib.sha256(b"x,y").hexdigest()


@pytest.mark.parametrize("block", [1 << 25, 60])
def test_items_without_id(spark, block):
    """A document that holds an item without an id is hit and goes; the item adds no id."""
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(None, item), (None, item), ("z", "w " * 30), (None, None)], "item_id string, text string")
    df = odd_documents(spark, [f"x {item} y", "w " * 12 + item, "clean"])
    got = {x.doc_id: x for x in decontaminate.digest(decontaminate.find(df, bench, block_bytes=block)).collect()}
    assert (got[0].n_hit, got[0].n_items, got[0].contaminated) == (11, 0, True) and got[0].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[1].n_hit, got[1].n_items, got[1].items_sha256) == (23, 1, hashlib.sha256(b"z").hexdigest())
    assert {x.doc_id for x in decontaminate.remove(df, bench).collect()} == {2, 1000, 1001, 1002}


def test_very_long_text(spark):
    item = " ".join(f"w{i}" for i in range(12))
    df = odd_documents(spark, ["long text " * 300_000 + item])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {x.doc_id: (x.n_words, sum(b - a for a, b in x.spans), x.longest) for x in decontaminate.find(df, bench).collect()}
    assert got[0] == (600_012, 12, 12)


def test_longest_match_and_empty_tables(spark):
    item = " ".join(f"w{i}" for i in range(40))
    df = odd_documents(spark, ["x " + item[10:120] + " y", item + " " + item])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {x.doc_id: x.longest for x in decontaminate.find(df, bench).collect()}
    assert got[1] == 40 and 10 <= got[0] < 40 and got[1000] == 0
    assert decontaminate.digest(decontaminate.find(df, bench.limit(0))).where("contaminated").count() == 0
    assert decontaminate.find(df.limit(0), bench).count() == 0
