"""Word pairs exchanged as packed bytes: which keys stand in two documents, and sets of pairs by word.

A task collects the keys of its texts, keeps each once with a mark whether two of its own
documents hold it, and hands them over in buckets as five bytes each. A bucket is the
remainder of the hash, so buckets are even however often a key occurs, and their number
follows from the size of the table. Keys are cut to 40 bits and the bucket: a false
agreement lets a key pass that one document alone holds, which the exact step after it
sorts out.

Sets of pairs (word, history) go by word: in a bucket, a word is written once and each of its
histories takes six bytes, with one more for what is counted. A word's histories are spread
over the root of the number of buckets, so that no word fills a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.words import mix64

BUCKET_KEYS = 2_000_000
_REST = np.uint64((1 << 40) - 1)
_PART = pa.schema([("bucket", pa.int32()), ("twice", pa.bool_()), ("keys", pa.binary())])


def cut(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The form in which a key is compared."""
    n = np.uint64(buckets)
    return ((keys // n) & _REST) * n + keys % n


def buckets_for(keys: float) -> int:
    return int(min(max(1, -(-keys // BUCKET_KEYS)), 1 << 16))


def _flush(found: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    key, owner = (np.concatenate([x[i] for x in found]) for i in range(2))
    key = cut(key, buckets)
    order = np.argsort(key, kind="stable")  # owners stay in rising order
    key, owner = key[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    last = np.append(first[1:], len(key)) - 1
    twice, key = owner[first] != owner[last], key[first]
    place = (key % np.uint64(buckets)).astype(np.int64) * 2 + twice
    order = np.argsort(place, kind="stable")
    place, rest = place[order], (key[order] // np.uint64(buckets)).astype("<u8")
    data = np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8)[:, :5])
    at = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    blobs = [data[i:j].tobytes() for i, j in zip(at, np.append(at[1:], len(place)))]
    yield pa.RecordBatch.from_arrays([pa.array(place[at] // 2, pa.int32()), pa.array(place[at] % 2 == 1), pa.array(blobs, pa.binary())], schema=_PART)


def _merge(group: pa.Table) -> pa.Table:
    bucket = group.column("bucket")[0].as_py()
    keys, marks = [], []
    for twice, blob in zip(group.column("twice").to_pylist(), group.column("keys").to_pylist()):
        five = np.frombuffer(blob, np.uint8).reshape(-1, 5)
        wide = np.zeros((len(five), 8), np.uint8)
        wide[:, :5] = five
        keys.append(wide.view("<u8").ravel())
        marks.append(np.full(len(five), twice))
    key, mark = np.concatenate(keys), np.concatenate(marks)
    order = np.argsort(key, kind="stable")
    key, mark = key[order], mark[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    deep = (np.diff(np.append(first, len(key))) > 1) | np.logical_or.reduceat(mark, first)
    n = np.uint64(group.column("buckets")[0].as_py())
    return pa.table({"k": pa.array((key[first[deep]] * n + np.uint64(bucket)).astype(np.int64), pa.int64())})


def in_two(rows: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], buckets: int) -> DataFrame:
    """``k``: keys (cut) that two rows hold. ``keys`` yields keys and the row of the batch each belongs to."""

    def run(batches):
        found, n, owners = [], 0, 0
        for b in batches:
            for key, owner in keys(b):
                found.append((key, owner + owners))
                n += len(key)
                if n >= BUCKET_KEYS:
                    yield from _flush(found, buckets)
                    found, n = [], 0
            owners += b.num_rows
        if n:
            yield from _flush(found, buckets)

    parts = rows.mapInArrow(run, "bucket int, twice boolean, keys binary").withColumn("buckets", F.lit(buckets))
    return parts.groupBy("bucket").applyInArrow(_merge, "k long")


HISTORY_BITS = 48
SETS = "bucket int, words binary, sizes binary, entries binary"
_SETS = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("sizes", pa.binary()), ("entries", pa.binary())])


def bucket_of(word: np.ndarray, history: np.ndarray, buckets: int) -> np.ndarray:
    part = mix64(history) % np.uint64(max(1, int(np.sqrt(buckets))))
    return (mix64(word + part * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)


def sets(word: np.ndarray, history: np.ndarray, code: np.ndarray | None, buckets: int, kept: int = 6) -> pa.RecordBatch:
    """One row per bucket: its words, how many entries each has, and the entries (``kept`` bytes of the history, then the code if there is one)."""
    bucket = bucket_of(word, history, buckets)
    # runs of a word: two words that agree in 48 bits may alternate, which makes more runs only
    order = np.argsort((bucket.astype(np.uint64) << np.uint64(48)) | (word >> np.uint64(16)), kind="stable")
    bucket, word, history = bucket[order], word[order], history[order]
    wide = np.ascontiguousarray(history.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :kept]
    entry = np.ascontiguousarray(wide if code is None else np.column_stack((wide, code[order].astype(np.uint8))))
    run = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (word[1:] != word[:-1])))) if len(word) else np.empty(0, np.int64)
    size = np.diff(np.append(run, len(word))).astype("<u4")
    owner, name = bucket[run], word[run].astype("<u8")
    at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(run) else np.empty(0, np.int64)
    ends = np.append(at[1:], len(run))
    edge = np.append(run, len(word))
    cells = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(at, ends)], pa.binary())
    entries = pa.array([entry[edge[i] : edge[j]].tobytes() for i, j in zip(at, ends)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(owner[at], pa.int32()), cells(name), cells(size), entries], schema=_SETS)


def unpacked(group: pa.Table, width: int, kept: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Word, history and code of all entries of a bucket; ``width``: bytes of an entry, with a code one more than those of the history."""
    joined = lambda c, kind: np.frombuffer(b"".join(group.column(c).to_pylist()), kind)
    entry = joined("entries", np.uint8).reshape(-1, width)
    wide = np.zeros((len(entry), 8), np.uint8)
    wide[:, :kept] = entry[:, :kept]
    word = np.repeat(joined("words", "<u8"), joined("sizes", "<u4"))
    return word, wide.view("<u8").ravel(), entry[:, kept] if width > kept else None
