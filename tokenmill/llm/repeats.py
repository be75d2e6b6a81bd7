"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix is a word position with the words after it; two positions repeat when their
suffixes share a path of ``size`` words, that is, when they lie below one internal node of
depth ``size`` in the suffix tree of all documents. The tree is never whole anywhere:

1. *Which subtrees can be deep.* The smallest 8-word hash of each window stands for it;
   equal windows agree in it, so a window whose value occurs in one document only cannot
   repeat. One row per document and distinct value decides that (about 1/22 of the words).
2. *Prefixes.* The remaining suffixes are partitioned by their first 8 words. A prefix
   that more than ``GROUP`` suffixes have is lengthened to the whole window; a path still
   held by more than ``GROUP`` is a single deep node, of which only the smallest doc_id
   matters, and that is found by partial aggregation.
3. *Subtrees.* Suffixes of a prefix stand sorted by path and document (Spark's external
   sort), so a task reads a subtree as a stream: a run of equal paths is a node, its first row
   the smallest document below it. Every later document's window is a repeat.
4. Windows of a document that follow each other are one maximal repeat; the words
   covered are cut out of the whole text.

Defined cases: null and empty texts have no words; a document of fewer than ``size``
words keeps all; rows that repeat a doc_id are never a source of each other, and each is
cut by its own text: where an id has several texts, a start carries its path and counts
only in the text that holds that window there; rows without a doc_id are returned whole
and are nobody's source.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm import bitmap
from tokenmill.llm.base import arrow_stage, batch, stored
from tokenmill.llm.words import SPACED, Words, gram_hashes, slices, words

SIZE = 50
PREFIX = 8
GROUP = 50_000  # suffixes in a subtree that one task reads, as long as a longer prefix can split it

_KEY = pa.schema([("k", pa.int64()), ("doc_id", pa.int64())])
_SUFFIX = pa.schema([("prefix", pa.int64()), ("path", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])
_START = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("path", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def least_of(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest of ``n`` values from each place on (the last ``n - 1`` places are not whole)."""
    step = 1
    x = x.copy()
    while 2 * step <= n:
        x[:-step] = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:-step]
        step *= 2
    rest = n - step
    if rest and len(x) > rest:
        x[:-rest] = np.minimum(x[:-rest], x[rest:])
    return x


def window_keys(w: Words, size: int, prefix: int):
    """Of each whole window: its word position, its smallest gram, its first gram."""
    gram, _ = gram_hashes(w, prefix)
    _, whole = gram_hashes(w, size)
    at = np.flatnonzero(whole)
    return at, least_of(gram, size - prefix + 1)[at], gram[at]


def _texts(b: pa.RecordBatch):
    for i, j in slices(b.column(1)):
        yield b.column(0).slice(i, j - i).to_numpy(zero_copy_only=False), words(b.column(1).slice(i, j - i), SPACED, lower=False)


def _keys(size: int, prefix: int):
    def of(b: pa.RecordBatch):
        for ids, w in _texts(b):
            at, key, _ = window_keys(w, size, prefix)
            pairs = np.unique(np.column_stack((w.text_of()[at].astype(np.uint64), key)), axis=0) if len(at) else np.empty((0, 2), np.uint64)
            yield batch(_KEY, pairs[:, 1].copy().view(np.int64), ids[pairs[:, 0].astype(np.int64)])

    return of


def _suffixes(size: int, prefix: int, bits):
    def of(b: pa.RecordBatch):
        for ids, w in _texts(b):
            at, key, first = window_keys(w, size, prefix)
            some = bitmap.test(bits.value, key.view(np.int64))
            at, first = at[some], first[some]
            if len(at):
                path, _ = gram_hashes(w, size)
                doc = np.searchsorted(w.offset, at, "right") - 1
                yield batch(_SUFFIX, first.view(np.int64), path[at].view(np.int64), ids[doc], (at - w.offset[doc]).astype(np.int32))

    return of


def _subtrees(batches):
    """Windows below a node whose smallest document is another one; input sorted by prefix, path, doc_id."""
    node, least = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        prefix, path, doc = (b.column(i).to_numpy() for i in range(3))
        new = np.ones(len(path), bool)
        new[1:] = (path[1:] != path[:-1]) | (prefix[1:] != prefix[:-1])
        new[0] = node != (prefix[0], path[0])
        first = np.flatnonzero(new)
        low = np.empty(len(path), np.int64)
        head = first[0] if len(first) else len(path)
        low[:head] = least
        if len(first):
            low[head:] = np.repeat(doc[first], np.diff(np.append(first, len(path))))
        node, least = (prefix[-1], path[-1]), low[-1]
        again = doc > low
        yield batch(_START, doc[again], b.column(3).filter(pa.array(again)), path[again])


def repeated_windows(docs: DataFrame, size: int = SIZE, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """``doc_id, pos, path``: starts of the windows that a smaller document has, too, and their hashes. Input: ``doc_id, text``."""
    spark = docs.sparkSession
    named = docs.where(F.col("doc_id").isNotNull())
    keys = named.mapInArrow(arrow_stage(_keys(size, prefix)), "k long, doc_id long")
    deep = stored(keys.groupBy("k").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("k"), "keys")
    bits = spark.sparkContext.broadcast(bitmap.build(deep, "k", deep.count()))
    all_ = stored(named.mapInArrow(arrow_stage(_suffixes(size, prefix, bits)), "prefix long, path long, doc_id long, pos int"), "suffixes")
    big = stored(all_.groupBy("prefix").count().where(F.col("count") > group).select("prefix"), "prefixes")
    if big.isEmpty():
        light, huge = all_, None
    else:
        longer = all_.join(big, "prefix", "left_semi")
        nodes = longer.groupBy("path").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo")).where(F.col("n") > group).select("path", "lo")
        nodes = stored(nodes, "nodes")
        huge = longer.join(nodes, "path").where("doc_id > lo").select("doc_id", "pos", "path")
        rest = longer.join(nodes, "path", "left_anti").select(F.col("path").alias("prefix"), "path", "doc_id", "pos")
        light = all_.join(big, "prefix", "left_anti").select("prefix", "path", "doc_id", "pos").unionByName(rest)
    out = light.repartition("prefix").sortWithinPartitions("prefix", "path", "doc_id").mapInArrow(_subtrees, "doc_id long, pos int, path long")
    return out if huge is None else out.unionByName(huge)


def _starts_of_ids(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, starts, checked``: the starts of each document; those of ids with several texts with their paths."""
    texts = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    several = stored(texts.where("a < b").select("doc_id", F.lit(True).alias("several")), "several")
    if several.isEmpty():
        return windows.groupBy("doc_id").agg(F.collect_set("pos").alias("starts")).withColumn("checked", F.array().cast("array<struct<pos:int,path:long>>"))
    marked = windows.join(several, "doc_id", "left")
    plain, checked = F.when(F.col("several").isNull(), F.col("pos")), F.when(F.col("several"), F.struct("pos", "path"))
    return marked.groupBy("doc_id").agg(F.collect_set(plain).alias("starts"), F.collect_set(checked).alias("checked"))


def _own(w: Words, starts: pa.Array, checked: pa.Array, size: int) -> list[np.ndarray]:
    """Of each text, its starts: all plain ones, and the checked ones whose window it has at that place."""
    out = [np.asarray(x or (), np.int64) for x in starts.to_pylist()]
    if pa.compute.any(pa.compute.greater(pa.compute.list_value_length(checked), 0)).as_py():
        path, whole = gram_hashes(w, size)
        path = path.view(np.int64)
        for k, pairs in enumerate(checked.to_pylist()):
            p, h = (np.array([x[c] for x in pairs or ()], np.int64) for c in ("pos", "path"))
            at = w.offset[k] + p
            at, p, h = (x[at < w.offset[k + 1]] for x in (at, p, h))
            out[k] = np.concatenate((out[k], p[whole[at] & (path[at] == h)]))
    return out


def _cut(ids, w: Words, starts, size: int, texts: bool):
    rows = [[], [], [], []]
    n = w.counts()
    for k in range(len(w)):
        keep = None
        gone = 0
        if starts is not None and len(starts[k]):
            mark = np.zeros(n[k] + 1, np.int32)
            p = np.unique(starts[k])
            p = p[p + size <= n[k]]
            mark[p] += 1
            mark[p + size] -= 1
            keep = np.cumsum(mark[:-1]) == 0
            gone = int(n[k] - keep.sum())
        kept = w.joined(k, keep)
        for r, x in zip(rows, (int(n[k]), gone, hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None)):
            r.append(x)
    return batch(_OUT, ids, *rows)


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, prefix: int = PREFIX, group: int = GROUP, texts: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` of every row; ``kept`` is null unless ``texts``."""
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    starts = stored(_starts_of_ids(repeated_windows(d, size, prefix, group), d), "starts")
    bits = spark.sparkContext.broadcast(bitmap.build(starts, "doc_id", starts.count()))

    def flagged(b):
        ids = b.column(0)
        return bitmap.test(bits.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)

    def whole(b):
        b = b.filter(pa.array(~flagged(b)))
        for i, j in slices(b.column(1)):
            yield _cut(b.column(0).slice(i, j - i), words(b.column(1).slice(i, j - i), SPACED, lower=False), None, size, texts)

    def cut(b):
        for i, j in slices(b.column(1)):
            w = words(b.column(1).slice(i, j - i), SPACED, lower=False)
            yield _cut(b.column(0).slice(i, j - i), w, _own(w, b.column(2).slice(i, j - i), b.column(3).slice(i, j - i), size), size, texts)

    clean = d.mapInArrow(arrow_stage(whole), RESULT)
    hit = d.mapInArrow(arrow_stage(lambda b: [b.filter(pa.array(flagged(b)))]), "doc_id long, text string")
    return clean.unionByName(hit.join(starts, "doc_id", "left").select("doc_id", "text", "starts", "checked").mapInArrow(arrow_stage(cut), RESULT))
