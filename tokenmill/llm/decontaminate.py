"""Benchmark decontamination by training suffix arrays.

Every slice of the training text (a shard) is sorted into a suffix array over words:
suffixes are ordered by the packed codes of their first four words. Every test suffix
that starts a window is binary-searched in it; the range found is narrowed word by
word on full word hashes until the whole window matches. Matches on one diagonal
(same item, same shift) join to longest verbatim matches with their locations.

No row is exchanged: the test windows (blocks of bounded size, measured first) go to the
training text. A benchmark of several blocks is searched block after block in the same
stage.

Defined cases: null or empty texts have no words and no hits; an item of fewer words
than a window is one window; repeated items count once per id; items without an id are
searched like others, but add no id to the items found. Documents are judged row by row, so repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.base import arrow_stage, batch, text_blocks
from tokenmill.llm.words import ALNUM, gram_hashes, slices, words

WINDOW = 10
BLOCK_BYTES = 32 << 20  # benchmark text held by a task at once
PAIRS = 1 << 20  # candidate pairs compared at once
_KEY_WORDS = 4

MATCHES = "doc_id long, n_words long, spans array<array<int>>, items array<string>, longest int"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string())), ("longest", pa.int32())])


@dataclass
class Windows:
    """Distinct test windows, sorted for search, and where they occur."""

    low: np.ndarray  # packed codes of the first words
    high: np.ndarray
    length: np.ndarray
    hashes: np.ndarray  # word hashes, one row per window
    at: np.ndarray  # CSR offsets into item / start
    item: np.ndarray
    start: np.ndarray
    names: list[str | None]  # None: an item without an id


def _codes(h: np.ndarray) -> np.ndarray:
    return h % np.uint64(65535) + np.uint64(1)  # 0 stands for the end of a text


def windows(ids: pa.Array, texts: pa.Array, size: int = WINDOW) -> Windows:
    w = words(texts, ALNUM)
    n = w.counts()
    names = [None if x is None else str(x) for x in ids.to_pylist()]
    long = n >= size
    _, whole = gram_hashes(w, size)
    starts = np.flatnonzero(whole & long[w.text_of()]) if len(w.hash) else np.empty(0, np.int64)
    short = w.offset[:-1][(n > 0) & ~long]
    begin = np.concatenate((starts, short)).astype(np.int64)
    length = np.concatenate((np.full(len(starts), size), n[(n > 0) & ~long])).astype(np.int64)
    item = np.searchsorted(w.offset, begin, "right") - 1
    table = np.zeros((len(begin), size), np.uint64)
    for k in range(size):
        has = length > k
        table[has, k] = w.hash[begin[has] + k]
    _, first, group = np.unique(np.column_stack((table, length.astype(np.uint64))), axis=0, return_index=True, return_inverse=True) if len(begin) else (None, np.empty(0, np.int64), np.empty(0, np.int64))
    order = np.argsort(group.ravel(), kind="stable")
    at = np.concatenate(([0], np.cumsum(np.bincount(group.ravel(), minlength=len(first))))).astype(np.int64)
    table, length = table[first], length[first]
    low, high = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)
    for k in range(_KEY_WORDS):
        has = length > k if k < size else np.zeros(len(first), bool)
        code = np.where(has, _codes(table[:, min(k, size - 1)]), np.uint64(0))
        low = (low << np.uint64(16)) | code
        high = (high << np.uint64(16)) | np.where(has, code, np.uint64(0xFFFF))
    return Windows(low, high, length, table, at, item[order], (begin - w.offset[item])[order], names)


def _found(w, test: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(word position, window) of every whole match in a slice."""
    h = w.hash
    n = len(h)
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not n or not len(test.low):
        return none
    end = np.repeat(w.offset[1:], w.counts())
    code = _codes(h)
    key = np.zeros(n, np.uint64)
    place = np.arange(n)
    for k in range(_KEY_WORDS):
        nxt = np.zeros(n, np.uint64)
        nxt[: n - k] = code[k:]
        nxt[place + k >= end] = 0
        key = (key << np.uint64(16)) | nxt
    order = np.argsort(key)  # the suffix array
    key = key[order]
    lo, hi = np.searchsorted(key, test.low, "left"), np.searchsorted(key, test.high, "right")
    size = hi - lo
    some = np.flatnonzero(size)
    out_p, out_t = [], []
    total = np.cumsum(size[some])
    i = 0
    while i < len(some):  # bounded pieces of candidate pairs
        base = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, base + PAIRS, "right")))
        t = np.repeat(some[i:j], size[some[i:j]])
        first = np.concatenate(([0], np.cumsum(size[some[i:j]])[:-1]))
        p = order[np.repeat(lo[some[i:j]] - first, size[some[i:j]]) + np.arange(len(t))]
        fits = p + test.length[t] <= end[p]
        p, t = p[fits], t[fits]
        for k in range(test.hashes.shape[1]):
            over = test.length[t] <= k
            same = over | (h[np.minimum(p + k, n - 1)] == test.hashes[t, k])
            p, t = p[same], t[same]
        out_p.append(p)
        out_t.append(t)
        i = j
    return (np.concatenate(out_p), np.concatenate(out_t)) if out_p else none


def _rows(p: np.ndarray, t: np.ndarray, first: int, n_words: int, test: Windows):
    """Spans of hit words, item names and the longest verbatim match of one document."""
    p = p - first
    mark = np.zeros(n_words + 1, np.int64)
    np.add.at(mark, p, 1)
    np.add.at(mark, p + test.length[t], -1)
    hit = np.cumsum(mark[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    spans = edge.reshape(-1, 2).tolist()
    items = np.unique(np.concatenate([test.item[test.at[u] : test.at[u + 1]] for u in np.unique(t)]))
    # diagonals: consecutive windows of an item at one shift are one longer match
    size = (test.at[t + 1] - test.at[t]).astype(np.int64)
    occ = np.repeat(test.at[t] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    pos, item, shift = np.repeat(p, size), test.item[occ], np.repeat(p, size) - test.start[occ]
    o = np.lexsort((pos, shift, item))
    pos, item, shift, length = pos[o], item[o], shift[o], np.repeat(test.length[t], size)[o]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(pos) != 1) | (np.diff(item) != 0) | (np.diff(shift) != 0))))
    last = np.append(new[1:], len(pos)) - 1
    longest = int((pos[last] + length[last] - pos[new]).max())
    return spans, sorted({test.names[i] for i in items} - {None}), longest


def _search(test: Windows, chained: bool):
    def of(b: pa.RecordBatch):
        ids, texts = b.column(0), b.column(1)
        for i, j in slices(texts):
            w = words(texts.slice(i, j - i), ALNUM)
            p, t = _found(w, test)
            doc = np.searchsorted(w.offset, p, "right") - 1
            o = np.argsort(doc, kind="stable")
            p, t, doc = p[o], t[o], doc[o]
            spans, items, longest = [[] for _ in range(j - i)], [[] for _ in range(j - i)], [0] * (j - i)
            for d, a, e in zip(*(x.tolist() for x in _runs(doc))):
                spans[d], items[d], longest[d] = _rows(p[a:e], t[a:e], w.offset[d], int(w.offset[d + 1] - w.offset[d]), test)
            if chained:
                old = [b.column(k).slice(i, j - i).to_pylist() for k in (3, 4, 5)]
                spans = [_united(x + y) for x, y in zip(old[0], spans)]
                items = [sorted(set(x) | set(y)) for x, y in zip(old[1], items)]
                longest = [max(x, y) for x, y in zip(old[2], longest)]
            yield ids.slice(i, j - i), texts.slice(i, j - i), w.counts(), spans, items, longest

    return of


def _runs(x: np.ndarray):
    a = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
    return x[a], a, np.append(a[1:], len(x)) if len(x) else a


def _united(spans: list) -> list:
    out: list = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: words, spans of hit words ``[start, end)``, ids of the items found, longest match in words."""
    spark = docs.sparkSession
    df = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = [spark.sparkContext.broadcast(windows(t["key"].combine_chunks(), t["text"].combine_chunks(), window)) for t in text_blocks(benchmark, item_id, item_text, block_bytes)]
    full = pa.schema([_SCHEMA.field(0), ("text", pa.string()), *list(_SCHEMA)[1:]])
    for k, b in enumerate(blocks):
        last = k == len(blocks) - 1

        def stage(x, b=b, last=last, chained=k > 0):
            for ids, texts, n, spans, items, longest in _search(b.value, chained)(x):
                if last:
                    yield batch(_SCHEMA, ids, n, spans, items, longest)
                else:
                    yield batch(full, ids, texts.cast(pa.string()), n, spans, items, longest)

        names = MATCHES if last else MATCHES.replace("n_words", "text string, n_words")
        df = df.mapInArrow(arrow_stage(stage), names)
    return df


def hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: counts, item ids as a hash, and the verdict."""
    n_hit = hit_words()
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def contaminated(spark, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
    """A function of a text column: whether any benchmark window occurs in it. Null texts are clean."""
    blocks = [spark.sparkContext.broadcast(windows(t["key"].combine_chunks(), t["text"].combine_chunks(), window)) for t in text_blocks(benchmark, "item_id", "text", block_bytes)]

    @F.arrow_udf("boolean")
    def is_hit(texts: pa.Array) -> pa.Array:
        hit = np.zeros(len(texts), bool)
        for i, j in slices(texts):
            w = words(texts.slice(i, j - i), ALNUM)
            for b in blocks:
                p, _ = _found(w, b.value)
                hit[i + np.searchsorted(w.offset, p, "right") - 1] = True
        return pa.array(hit)

    return is_hit


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` (all columns) without the documents that hold a benchmark window."""
    return docs.where(~contaminated(docs.sparkSession, benchmark, window)(F.col(text)))
