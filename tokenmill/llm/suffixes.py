"""Substring dedup over bytes by suffix arrays, sorted deep and shallow.

A window is ``size`` bytes of one text; it repeats when it also starts in a document with a
smaller doc_id. The suffixes of all texts are never sorted as one:

1. *Partitions.* The smallest hash of ``gram`` bytes inside a window names its partition;
   equal windows agree in it. Neighbouring windows mostly share it, and such a run is kept
   as one record. Runs whose name stands in one document alone cannot repeat and go no
   further (``packed.in_two``).
2. *Equal records.* Of records with equal bytes only those of the smallest document go on;
   all windows of the others are repeats. A task settles its own first, so a passage that
   a third of all documents hold reaches the next step once a task and not once a document.
3. *Sorting.* The suffixes of a partition are ordered by multikey quicksort on symbols of
   eight bytes down to a shallow depth; groups still equal are ordered by blind tries:
   one suffix is the trie's path, every other one is compared with it once, hangs at the node
   where it leaves the path, and those that hang together form the next trie. Suffixes
   that agree in ``size`` bytes are one class; all but its smallest document's are repeats.
   A partition of more than ``group`` records is split by the whole window's hash.
4. Bytes covered by repeating windows are cut out of the whole text.

Defined cases: null and empty texts have no bytes; texts shorter than ``size`` stay whole; rows
that repeat a doc_id are never repeats of each other and each is cut by its own windows;
rows without a doc_id are returned whole and are nobody's source. What is kept may be
cut inside a character, so ``kept`` is binary.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm import bitmap, packed
from tokenmill.llm.base import arrow_stage, batch, stored
from tokenmill.llm.repeats import least_of
from tokenmill.llm.words import _BYTE, buffers, mix64, slices

SIZE = 50
GROUP = 20_000  # records of a partition that one task sorts together
SHALLOW = 16  # bytes
SLICE = 1 << 18  # bytes of text hashed at once; a longer text is hashed alone
RUN = 256  # windows of a record, at most
FLUSH = 500_000  # records that a task settles by itself
SORTED = 300_000  # windows sorted at once

_U = np.uint64
_RECORD = pa.schema([("key", pa.int64()), ("rec", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int32()), ("pos", pa.int32()), ("n", pa.int32()), ("again", pa.bool_())])
_BYTES = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int32()), ("pos", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
_RANGE = pa.schema([("doc_id", pa.int64()), ("th", pa.int32()), ("pos", pa.int32()), ("n", pa.int32())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


# ---- windows and records of texts


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xDA942042E4DD58B5
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n + 1, b, dtype=_U)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


class Hashed:
    """Prefix sums of a byte buffer: the hash of any range of it in constant time."""

    def __init__(self, raw: np.ndarray):
        size = 1 << max(SLICE.bit_length(), int(len(raw)).bit_length())
        self.up, self.down = _powers(size)
        self.total = np.zeros(len(raw) + 1, _U)
        np.cumsum(_BYTE[raw] * self.up[: len(raw)], out=self.total[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(_U)
        return mix64((self.total[end] - self.total[start]) * self.down[start] + size * _U(0x9E3779B97F4A7C15))

    def grams(self, n: int) -> np.ndarray:
        m = len(self.total) - n
        return mix64((self.total[n:] - self.total[:m]) * self.down[:m])


def records(raw: np.ndarray, off: np.ndarray, size: int):
    """Runs of windows with one name: their text, first and last-but-one window, name; and the hashes of the buffer."""
    if len(raw) < size:
        z = np.empty(0, np.int64)
        return z, z, z, np.empty(0, _U), None
    gram = max(1, size // 2 - 1)
    h = Hashed(raw)
    name = least_of(h.grams(gram), size - gram + 1)[: len(raw) - size + 1]
    new = np.ones(len(name) + 1, bool)
    new[1:-1] = name[1:] != name[:-1]
    # windows of a text start no later than size before its end
    bounds = np.concatenate((off[:-1], np.maximum(off[1:] - size + 1, off[:-1])))
    new[bounds[bounds <= len(name)]] = True
    start = np.flatnonzero(new)
    start, end = start[:-1], start[1:]
    text = np.searchsorted(off, start, "right") - 1
    inside = start + size <= off[text + 1]
    start, end, text = start[inside], end[inside], text[inside]
    if len(start) and (end - start).max() > RUN:
        times = -(-(end - start) // RUN)
        first = np.repeat(start, times) + RUN * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
        end, text, start = np.minimum(first + RUN, np.repeat(end, times)), np.repeat(text, times), first
    return text, start, end, name[start], h


def _texts(b: pa.RecordBatch, column: int):
    for i, j in slices(b.column(column), SLICE):
        yield i, j, *buffers(b.column(column).slice(i, j - i))


def _names(size: int):
    def of(b: pa.RecordBatch):
        for i, _, raw, off in _texts(b, 2):
            text, _, _, name, _ = records(raw, off, size)
            if len(name):
                yield name, text + i

    return of


def _first_key(key: np.ndarray, rec: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix64(mix64(key + rec * _U(0xD1342543DE82EF95)) + doc.astype(_U)).view(np.int64)


def _settled(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    """Records of one task: those that a smaller document of the same task has, too, are decided."""
    key, rec, doc, th, pos, n = (np.concatenate(x) for x in zip(*parts))
    both = mix64(key + rec * _U(0xD1342543DE82EF95))
    order = np.lexsort((doc, both))
    low = _lowest(both[order], doc[order])
    again = np.empty(len(order), bool)
    again[order] = doc[order] > low
    zero = _U(0)
    return batch(_RECORD, np.where(again, zero, key).view(np.int64), np.where(again, zero, rec).view(np.int64), doc, th, pos, n, again)


def _lowest(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The first document of each run of equal groups, at every place (sorted by group and document)."""
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    return np.repeat(doc[first], np.diff(np.append(first, len(group))))


def _records(size: int, buckets: int, bits):
    def run(batches):
        parts, n = [], 0
        for b in batches:
            ids, th = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j, raw, off in _texts(b, 2):
                text, start, end, name, h = records(raw, off, size)
                some = bitmap.test(bits.value, packed.cut(name, buckets).view(np.int64)) if len(name) else np.empty(0, bool)
                if not some.any():
                    continue
                text, start, end, name = text[some], start[some], end[some], name[some]
                parts.append([name, h.ranges(start, end + size - 1), ids[i:j][text], th[i:j][text], (start - off[text]).astype(np.int32), (end - start).astype(np.int32)])
                n += len(name)
                if n >= FLUSH:
                    yield _settled(parts)
                    parts, n = [], 0
        if n:
            yield _settled(parts)

    return run


def _firsts(batches):
    """Marks records whose equals stand in a smaller document; input sorted by key, rec, doc_id."""
    node, least = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        key, rec, doc = (b.column(k).to_numpy() for k in range(3))
        new = np.ones(len(key), bool)
        new[1:] = (rec[1:] != rec[:-1]) | (key[1:] != key[:-1])
        new[0] = node != (key[0], rec[0])
        first = np.flatnonzero(new)
        head = first[0] if len(first) else len(key)
        low = np.full(len(key), least, np.int64)
        if len(first):
            low[head:] = np.repeat(doc[first], np.diff(np.append(first, len(key))))
        node, least = (key[-1], rec[-1]), low[-1]
        yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(doc > low)], schema=_RECORD)


def _contents(size: int, mixed, wide, firsts):
    """Bytes of the records to be sorted; where a partition is wide, of each window alone."""

    def of(b: pa.RecordBatch):
        ids, th = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for i, j, raw, off in _texts(b, 2):
            text, start, end, name, h = records(raw, off, size)
            if not len(name):
                continue
            some = np.flatnonzero(bitmap.test(mixed.value, name.view(np.int64)))
            some = some[bitmap.test(firsts.value, _first_key(name[some], h.ranges(start[some], end[some] + size - 1), ids[i:j][text[some]]))]
            if not len(some):
                continue
            text, start, end, name = text[some], start[some], end[some], name[some]
            split = bitmap.test(wide.value, name.view(np.int64))
            if split.any():
                n = np.where(split, end - start, 1)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                text, name, split = (np.repeat(x, n) for x in (text, name, split))
                start = np.repeat(start, n) + step
                end = np.where(split, start + 1, np.repeat(end, n))
                name = np.where(split, mix64(name + h.ranges(start, start + size)), name)
            width = end - start + size - 1
            at = np.repeat(start - np.cumsum(width) + width, width) + np.arange(width.sum())
            ends = np.concatenate(([0], np.cumsum(width))).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(width), [None, pa.py_buffer(ends), pa.py_buffer(raw[at])])
            yield batch(_BYTES, name.view(np.int64), ids[i:j][text], th[i:j][text], (start - off[text]).astype(np.int32), (end - start).astype(np.int32), data)

    return of


# ---- sorting


def _symbols(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as one number in byte order (``raw`` is padded)."""
    return np.ascontiguousarray(sliding_window_view(raw, 8)[at]).view("<u8").ravel().byteswap()


def _heads(rank: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of each run of equal ranks, at every place."""
    first = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
    size = np.diff(np.append(first, len(rank)))
    return np.repeat(places[first], size), np.repeat(size, size)


def _quicksort(order: np.ndarray, head: np.ndarray, sym: np.ndarray, todo: np.ndarray) -> None:
    """Ternary partitions of all classes at once, until each class has one symbol."""
    while len(todo):
        h = head[todo]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.append(first, len(todo)))
        s = sym[todo]
        pivot = np.repeat(s[first + size // 2], size)
        side = (s >= pivot).astype(np.int64) + (s > pivot)
        rank = np.repeat(np.arange(len(first)) * 3, size) + side
        o = np.argsort(rank, kind="stable")
        order[todo], sym[todo], rank = order[todo][o], s[o], rank[o]
        head[todo], n = _heads(rank, todo)
        todo = todo[(rank % 3 != 1) & (n > 1)]


def _shared(raw: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, size: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, which agree down to ``depth``; ``size`` at most."""
    out = np.full(len(a), size, np.int64)
    todo = np.arange(len(a))
    for d in range(depth, size, 8):
        x = _symbols(raw, a[todo] + d) ^ _symbols(raw, b[todo] + d)
        differ = x != 0
        if differ.any():
            y = x[differ]
            same = sum((y < _U(1 << (8 * k))).astype(np.int64) for k in range(1, 8))
            out[todo[differ]] = np.minimum(d + same, size)
            todo = todo[~differ]
        if not len(todo):
            break
    return out


def _blind_tries(raw: np.ndarray, at: np.ndarray, order: np.ndarray, head: np.ndarray, todo: np.ndarray, depth: int, size: int) -> None:
    """Order classes of equal prefixes: each suffix hangs at the node where it leaves its class's first one."""
    while len(todo):
        h = head[todo]
        here, path = at[order[todo]], at[order[h]]
        node = _shared(raw, here, path, depth, size)
        end = node >= size
        byte, own = raw[here + node].astype(np.int64), raw[path + node]
        side = np.where(end, 1, np.where(byte < own, 0, 2))
        byte[end] = 0
        # before the path: nodes from the root down; behind it: from the leaf up
        level = np.where(side == 0, node, np.where(side == 2, size - node, 0))
        index = np.cumsum(np.concatenate(([0], (h[1:] != h[:-1]).astype(np.int64))))
        rank = ((index * 3 + side) * (size + 1) + level) * 256 + byte
        o = np.argsort(rank, kind="stable")
        order[todo], rank, side = order[todo][o], rank[o], side[o]
        head[todo], n = _heads(rank, todo)
        todo = todo[(side != 1) & (n > 1)]


def sort_suffixes(raw: np.ndarray, at: np.ndarray, group: np.ndarray, size: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``at`` by group and their first ``size`` bytes, and the first place of each class of equals.

    All have ``size`` bytes. ``raw`` is padded with ``size`` bytes and more.
    """
    order = np.argsort(group, kind="stable")
    head, n = _heads(group[order], np.arange(len(order))) if len(order) else (order.copy(), order.copy())
    shallow = min(shallow, size - size % 8)
    for d in range(0, shallow, 8):
        todo = np.flatnonzero(n > 1)
        sym = np.zeros(len(order), _U)
        sym[todo] = _symbols(raw, at[order[todo]] + d)
        _quicksort(order, head, sym, todo)
        n = np.bincount(head, minlength=len(order))[head]
    _blind_tries(raw, at, order, head, np.flatnonzero(n > 1), shallow, size)
    return order, head


def _windows(t: pa.Table):
    """Buffer, window places, and the record of each window."""
    data = t.column("data").combine_chunks()
    data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
    off = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    raw = np.frombuffer(data.buffers()[2], np.uint8)[off[0] : off[-1]]
    n = t.column("n").to_numpy().astype(np.int64)
    rec = np.repeat(np.arange(len(n)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.concatenate((raw, np.zeros(64, np.uint8))), (off[:-1] - off[0])[rec] + step, rec, step


def _sort_groups(t: pa.Table, size: int, keep: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
    """Ranges of repeating windows of whole partitions; with ``keep`` also each class's first window, for what follows."""
    raw, at, rec, step = _windows(t)
    raw = np.concatenate((raw, np.zeros(size, np.uint8)))
    part, doc, th, pos = (t.column(c).to_numpy() for c in ("part", "doc_id", "th", "pos"))
    order, head = sort_suffixes(raw, at, part[rec], size)
    d = doc[rec][order]
    first = np.flatnonzero(head == np.arange(len(head)))
    low = np.minimum.reduceat(d, first)
    flag = np.zeros(len(order), bool)
    flag[order] = d > np.repeat(low, np.diff(np.append(first, len(d))))
    flag &= pos[rec] >= 0
    at_flag = np.flatnonzero(flag)
    new = np.ones(len(at_flag), bool)
    new[1:] = (np.diff(at_flag) != 1) | (rec[at_flag][1:] != rec[at_flag][:-1])
    a = at_flag[new]
    n = np.diff(np.append(np.flatnonzero(new), len(at_flag)))
    out = batch(_RANGE, doc[rec[a]], th[rec[a]], (pos[rec[a]] + step[a]).astype(np.int32), n.astype(np.int32))
    if not keep:
        return out, None
    one = order[first]
    data = [raw[x : x + size].tobytes() for x in at[one]]
    kept = pa.table([part[rec[one]], low, np.zeros(len(one), np.int32), np.full(len(one), -1, np.int32), np.ones(len(one), np.int32), pa.array(data, pa.binary())], schema=_BYTES)
    return out, kept


def _repeats(size: int):
    """Repeating windows of each partition, in pieces of whole partitions; a larger one piece by piece, with the windows found so far."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            n += int(b.column(4).to_numpy().sum())
            if n < SORTED:
                continue
            t = pa.concat_tables(held)
            part = t.column("part").to_numpy()
            cut = int(np.searchsorted(part, part[-1], "left"))
            if cut:
                out, _ = _sort_groups(t.slice(0, cut), size, False)
                rest = t.slice(cut)
            else:
                out, rest = _sort_groups(t, size, True)
            yield out
            held, n = [rest], 0 if not cut else int(rest.column("n").to_numpy().sum())
        if held:
            yield _sort_groups(pa.concat_tables(held), size, False)[0]

    return run


# ---- the operator


def repeated_windows(docs: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """``doc_id, th, pos, n``: runs of windows that a smaller document has, too. Input: ``doc_id, th, text``."""
    sc = docs.sparkSession.sparkContext
    named = docs.where(F.col("doc_id").isNotNull())
    total = named.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    buckets = packed.buckets_for(total / 12)
    send = lambda table, column: sc.broadcast(bitmap.build(table, column, table.count()))
    deep = stored(packed.in_two(named, _names(size), buckets), "names")
    bits = send(deep, "k")
    found = stored(named.mapInArrow(_records(size, buckets, bits), "key long, rec long, doc_id long, th int, pos int, n int, again boolean"), "records")
    bits.destroy()
    open_ = found.where("NOT again").repartition("rec", "key").sortWithinPartitions("key", "rec", "doc_id")
    decided = stored(open_.mapInArrow(_firsts, "key long, rec long, doc_id long, th int, pos int, n int, again boolean"), "decided")
    firsts = decided.where("NOT again")
    names = stored(firsts.groupBy("key").count().where("count > 1"), "mixed")
    key = F.arrow_udf(lambda k, r, d: pa.array(_first_key(*(x.to_numpy(zero_copy_only=False).view(_U) for x in (k, r)), d.to_numpy(zero_copy_only=False))), "long")
    each = firsts.join(names.select("key"), "key", "left_semi").select(key("key", "rec", "doc_id").alias("k"))
    each = stored(each, "firsts")
    filters = [send(names, "key"), send(names.where(F.col("count") > group), "key"), send(each, "k")]
    rows = named.mapInArrow(arrow_stage(_contents(size, *filters)), "part long, doc_id long, th int, pos int, n int, data binary")
    sorted_ = rows.repartition("part").sortWithinPartitions("part", "doc_id").mapInArrow(_repeats(size), "doc_id long, th int, pos int, n int")
    out = stored(sorted_, "repeats")
    for f in filters:
        f.destroy()
    columns = ("doc_id", "th", "pos", "n")
    return found.where("again").select(*columns).union(decided.where("again").select(*columns)).union(out)


def _cut(ids: pa.Array, texts: pa.Array, ranges: pa.Array | None, size: int, kept_bytes: bool) -> pa.RecordBatch:
    raw, off = buffers(texts)
    rows = [[], [], [], [], []]
    if ranges is not None:
        place = ranges.offsets.to_numpy()
        run_pos, run_n = (ranges.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(2))
    for k in range(len(off) - 1):
        text = raw[off[k] : off[k + 1]]
        removed = spans = 0
        if ranges is not None and place[k + 1] > place[k]:
            pos, n = run_pos[place[k] : place[k + 1]], run_n[place[k] : place[k + 1]]
            mark = np.zeros(len(text) + 1, np.int64)
            np.add.at(mark, pos, 1)
            np.add.at(mark, pos + n + size - 1, -1)
            gone = np.cumsum(mark[:-1]) > 0
            removed = int(gone.sum())
            spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
            text = text[~gone]
        data = text.tobytes()
        for r, x in zip(rows, (int(off[k + 1] - off[k]), removed, spans, hashlib.sha256(data).hexdigest(), data if kept_bytes else None)):
            r.append(x)
    return batch(_OUT, ids, *rows)


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, group: int = GROUP, bytes_kept: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every row; ``kept`` is null unless ``bytes_kept``."""
    sc = docs.sparkSession.sparkContext
    t = F.col(text).cast("string")
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.hash(t).alias("th"), t.alias("text"))
    ranges = repeated_windows(d, size, group).groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "n")).alias("ranges"))
    ranges = stored(ranges, "ranges")
    bits = sc.broadcast(bitmap.build(ranges, "doc_id", ranges.count()))

    def flagged(b):
        ids = b.column(0)
        return bitmap.test(bits.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)

    def whole(b):
        b = b.filter(pa.array(~flagged(b)))
        for i, j in slices(b.column(2)):
            yield _cut(b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), None, size, bytes_kept)

    def cut(b):
        for i, j in slices(b.column(1)):
            yield _cut(b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), b.column(2).slice(i, j - i), size, bytes_kept)

    clean = d.mapInArrow(arrow_stage(whole), RESULT)
    hit = d.mapInArrow(arrow_stage(lambda b: [b.filter(pa.array(flagged(b)))]), "doc_id long, th int, text string")
    return clean.unionByName(hit.join(ranges, ["doc_id", "th"], "left").select("doc_id", "text", "ranges").mapInArrow(arrow_stage(cut), RESULT))
