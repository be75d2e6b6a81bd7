"""Substring dedup against all windows."""

import hashlib
import re

import pytest

from tests.llm.common import odd_documents, rng, text
from tokenmill.llm import repeats


def _brute(rows, size):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in docs:
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            least[k] = min(least.get(k, i), i)
    out = {}
    for i, w in docs:
        gone = set()
        for p in range(len(w) - size + 1):
            if least[tuple(w[p : p + size])] < i:
                gone |= set(range(p, p + size))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("size,prefix,group", [(12, 3, 10**6), (12, 3, 2), (50, 8, 5)])
def test_all_windows(spark, size, prefix, group):
    r = rng(size + group)
    passage = [text(r, size + r.randrange(-2, 30)) for _ in range(4)]
    texts = [" ".join(r.choice([text(r, r.randrange(0, 40)), r.choice(passage)]) for _ in range(r.randrange(1, 5))) for _ in range(40)]
    texts += [texts[3], texts[3], "Same " * 90, "Same " * 70, "same " * 70]
    df = odd_documents(spark, texts, [(2000, "no  id gap", "", "", 0)])
    want = _brute([(x.doc_id, x.text) for x in df.collect()], size)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256, x.kept) for x in repeats.remove(df, size=size, prefix=prefix, group=group).collect()}
    assert got == want


@pytest.mark.parametrize("group", [10**6, 2])
def test_one_id_with_several_texts(spark, group):
    """Each row is cut by its own text: only what a smaller id has goes, wherever the other rows of the id hold it."""
    w = [[f"{c}{i}" for i in range(100)] for c in "abc"]
    a, b, c = (" ".join(x) for x in w)
    mixed = " ".join(w[2][:30] + w[0][20:90] + w[2][30:50])
    rows = [(1, a, "", "", 0), (2, a, "", "", 0), (2, b, "", "", 0), (2, mixed, "", "", 0), (2, None, "", "", 0), (3, b, "", "", 0), (4, c, "", "", 0), (4, c, "", "", 0)]
    got = sorted((x.doc_id, x.n_words, x.n_removed, x.kept) for x in repeats.remove(spark.createDataFrame(rows, "doc_id long, text string, path string, several string, pos long"), group=group).collect())
    assert got == sorted([(1, 100, 0, a), (2, 100, 100, ""), (2, 100, 0, b), (2, 120, 70, " ".join(w[2][:50])), (2, 0, 0, ""), (3, 100, 100, ""), (4, 100, 0, c), (4, 100, 0, c)])


def test_very_long_text(spark):
    """A text of megabytes that ends with a passage of another document."""
    r = rng(9)
    head = [f"x{r.randrange(10**6)}" for _ in range(400_000)]
    tail = [f"t{i}" for i in range(60)]
    df = odd_documents(spark, [" ".join(tail), " ".join(head + tail)])
    got = {x.doc_id: (x.n_words, x.n_removed) for x in repeats.remove(df, texts=False).collect()}
    assert got[0] == (60, 0) and got[1] == (400_060, 60)


def test_odd_ids_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(80))
    df = odd_documents(spark, [long], [(0, long, "", "", 0), (None, long, "", "", 0)])
    assert {x.n_removed for x in repeats.remove(df).collect()} == {0}
    assert repeats.remove(df.limit(0)).count() == 0
