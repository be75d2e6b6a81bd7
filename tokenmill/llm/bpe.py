"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text longer than a chunk is cut into overlapping chunks that are pre-tokenised and
encoded in parallel, each from its own first character. In the overlap, both chunks'
pre-token boundaries run into step ("resynchronise"): from the first boundary that both
have, a match of the pattern no longer depends on where the chunk began. The left chunk's
tokens up to there and the right chunk's from there on are those of the whole text.

Every chunk ends after a place that is a boundary whatever came before (non-space before
space; letter or number before symbol), so a common boundary always exists; where a
text has no such place the chunk goes on to the next one, or to the text's end.
Decoding concatenates the bytes of the ids.

Defined cases: a null or empty text has no ids; results are one per row, so repeated rows
are repeated; text that looks like a special token is ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.base import batch

CHUNK = 32_768  # characters from one chunk's start to the next's
OVERLAP = 512
_SEEN = 3  # longest contraction of the pattern: boundaries nearer to a cut end may be wrong
_CACHED = 200_000  # pieces a worker remembers at most

DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS = "doc_id long, ids array<int>"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_CUT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("at", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("upto", pa.int64()), ("text", pa.string())])
_PART = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("ids", pa.list_(pa.int32())), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])
_sql = lambda s: ", ".join(f"{f.name} {({'int64': 'long', 'int32': 'int', 'bool': 'boolean', 'string': 'string', 'list<item: int32>': 'array<int>', 'list<item: int64>': 'array<long>'})[str(f.type)]}" for f in s)
_sure = r"(?<=\S)(?=\s)|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])"


class Coder:
    """A rank file with its pattern; sent to the executors as bytes (a file of fixed size)."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.rank_file, self.pattern = rank_file, pattern

    def __getstate__(self):
        return {"rank_file": self.rank_file, "pattern": self.pattern}

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.rank_file.splitlines()) if a}

    @cached_property
    def library(self):
        import tiktoken

        return tiktoken.Encoding("file", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def matcher(self):
        import regex

        return regex.compile(self.pattern)

    @cached_property
    def sure(self):
        import regex

        return regex.compile(_sure)

    @cached_property
    def bytes_of(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            out[i] = token
        return out

    @cached_property
    def digits_of(self) -> list[str]:
        return [str(i) for i in range(len(self.bytes_of))]

    @cached_property
    def known(self) -> dict[str, list[int]]:
        return {}

    def whole(self, text: str) -> list[int]:
        return self.library.encode_ordinary(text) if text else []

    def pieces(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids of a chunk, the start of each pre-token, and how many ids precede it."""
        known, ids, starts, before = self.known, [], [], []
        for m in self.matcher.finditer(text):
            p = m.group()
            starts.append(m.start())
            before.append(len(ids))
            got = known.get(p)
            if got is None:
                if len(known) >= _CACHED:
                    known.clear()
                got = known[p] = self.library._encode_single_piece(p.encode())
            ids += got
        return ids, np.array(starts, np.int64), np.array(before, np.int64)

    def decode(self, ids) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])

    def written(self, ids) -> str:
        table = self.digits_of
        return ",".join([table[i] for i in ids])


def cuts(text: str, sure, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Bounds of the overlapping chunks of a text."""
    a, n = 0, len(text)
    while True:
        m = sure.search(text, a + chunk + 1) if a + chunk + 1 < n else None
        if m is None:
            yield a, n
            return
        r = m.start()
        nxt = max(a + chunk, r - overlap // 2)
        yield a, min(n, max(r + _SEEN, nxt + overlap))
        a = nxt


def _cut(coder, chunk, overlap):
    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                bounds = list(cuts(text, coder.value.sure, chunk, overlap))
                for k, (a, e) in enumerate(bounds):
                    tail = bounds[k + 1][0] if k + 1 < len(bounds) else e
                    head = bounds[k - 1][1] if k else a
                    upto = e if e == len(text) else e - _SEEN
                    yield batch(_CUT, [row], [doc], [k], [k + 1 == len(bounds)], [a], [head], [tail], [upto], [text[a:e]])
                row += 1

    return run


def _encode_chunks(coder):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, starts, before = coder.value.pieces(r["text"])
                starts += r["at"]
                head = starts <= r["head"]
                tail = (starts >= r["tail"]) & (starts <= r["upto"])
                pairs = [np.column_stack((starts[x], before[x])).ravel() for x in (head, tail)]
                yield batch(_PART, [r["row"]], [r["doc_id"]], [r["chunk"]], [r["last"]], [ids], [pairs[0].tolist()], [pairs[1].tolist()])

    return run


def _meet(tail: list[int], head: list[int]) -> tuple[int, int]:
    """Ids of the left chunk before, and of the right chunk before, the first boundary that both have."""
    left, right = dict(zip(tail[::2], tail[1::2])), dict(zip(head[::2], head[1::2]))
    both = left.keys() & right.keys()
    if not both:
        raise ValueError("chunks never fall into step; their overlap is too small")
    s = min(both)
    return left[s], right[s]


def _stitch(coder, finish):
    """Rows of a text's chunks, in order, to one result; holds one chunk (and its successor) at a time."""

    def run(batches):
        held, state = None, None
        for b in batches:
            for r in b.to_pylist():
                if r["chunk"] == 0:
                    state, start = finish(coder.value), 0
                else:
                    stop, nxt = _meet(held["tail"], r["head"])
                    state.add(held["ids"][start:stop])
                    start = nxt
                if r["last"]:
                    state.add(r["ids"][start:])
                    yield state.row(r["doc_id"])
                    held = None
                else:
                    held = r

    return run


class _Digest:
    schema = _DIGEST

    def __init__(self, coder):
        self.coder, self.n, self.ids, self.text = coder, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids):
        if ids:
            self.ids.update((("," if self.n else "") + self.coder.written(ids)).encode())
            self.text.update(self.coder.decode(ids))
            self.n += len(ids)

    def row(self, doc):
        return batch(_DIGEST, [doc], [self.n], [self.ids.hexdigest()], [self.text.hexdigest()])


class _Ids:
    schema = _IDS

    def __init__(self, coder):
        self.ids: list[int] = []

    def add(self, ids):
        self.ids += ids

    def row(self, doc):
        return batch(_IDS, [doc], [self.ids])


def _short(coder, finish):
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    state = finish(coder.value)
                    state.add(coder.value.whole(text or ""))
                    rows.append(state.row(doc))
                yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0]

    return run


def load(spark, path: str, pattern: str):
    """Broadcast the rank file at ``path`` (read by the driver; a vocabulary, so of fixed size)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(Coder(f.read(), pattern))


def _encoded(docs: DataFrame, coder, finish, columns: str, doc_id: str, text: str, chunk: int, overlap: int) -> DataFrame:
    df = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = F.char_length(F.coalesce("text", F.lit("")))
    short = df.where(size <= chunk).mapInArrow(_short(coder, finish), columns)
    long = (
        df.where(size > chunk)
        .mapInArrow(_cut(coder, chunk, overlap), _sql(_CUT))
        .repartition("row", "chunk")
        .mapInArrow(_encode_chunks(coder), _sql(_PART))
        .repartition("row")
        .sortWithinPartitions("row", "chunk")
        .mapInArrow(_stitch(coder, finish), columns)
    )
    return short.unionByName(long)


def encode(docs: DataFrame, coder, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, ids`` of every row's whole text."""
    return _encoded(docs, coder, _Ids, IDS, doc_id, text, chunk, overlap)


def decode(coded: DataFrame, coder, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """Adds the bytes that the ids stand for."""

    @F.arrow_udf("binary")
    def concatenated(x: pa.Array) -> pa.Array:
        return pa.array([coder.value.decode(r or []) for r in x.to_pylist()], type=pa.binary())

    return coded.withColumn(out, concatenated(F.col(ids)))


def round_trip(docs: DataFrame, coder, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Encode, then decode the ids: counts and hashes only, so no ids leave the task that made them."""
    return _encoded(docs, coder, _Digest, DIGEST, doc_id, text, chunk, overlap)
