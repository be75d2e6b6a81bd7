"""MinHash near-duplicates with tensored banding, verified on full shingle sets.

Two small collections of ``m`` sub-keys are computed per document, each sub-key from ``r``
minhashes. A table key pairs one sub-key of the first collection with one of the second:
``m * m`` tables of ``2 * r`` minhashes each cost ``2 * m * r`` minhashes instead of
``2 * m * m * r``. A pair of similarity s shares no table with probability at most
``2 * (1 - s^r)^m``: 1.5e-5 at 0.85 with r = 4, 2e-5 at 0.8 with r = 3 (m = 16).

1. Documents with equal shingle sets are one class (its smallest doc_id stands for it).
2. Sub-keys that a single class has are dropped before keys are paired. Table keys link
   each class to the smallest class of its bucket, so candidate links are linear in the
   bucket; components of these links are the candidate groups. Every pair of classes
   that shares a table lies in one group.
3. A group is verified exactly on full sets, in blocks of bounded size: a task holds
   two blocks, finds all pairs of them in numbers, and emits a spanning forest only.
4. Components of the verified links give each document the smallest doc_id it reaches.

Shingles are compared as 64-bit hashes of all their bytes. Defined cases: documents
without words (null, empty, white space) have no shingles and stay alone; fewer words
than a shingle make one shingle of the whole; rows that repeat a doc_id are each judged by
their own text; rows without a doc_id are returned, linked with nothing and kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.llm import bitmap, graph
from tokenmill.llm.base import arrow_stage, batch, fresh, lists, stored
from tokenmill.llm.words import Words, gram_hashes, mix64, slices, words

M = 16
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20  # of a group that one side of a verifying task holds
_COLUMNS = 1 << 22  # cells of the 0/1 matrix at once

_SIG = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("th", pa.int64())])
_SET = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def minhashes(threshold: int) -> int:
    """r: minhashes in a sub-key."""
    return 4 if threshold >= 85 else 3


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and the offsets of the texts."""
    n, doc = w.counts(), w.text_of()
    h, whole = gram_hashes(w, size)
    parts, docs = [h[whole]], [doc[whole]]
    for c in range(1, size):
        some = np.flatnonzero(n == c)
        if len(some):
            g, _ = gram_hashes(w, c)
            parts.append(mix64(g[w.offset[some]] + np.uint64(c)))
            docs.append(some)
    h, doc = np.concatenate(parts), np.concatenate(docs)
    o = np.lexsort((h, doc))
    h, doc = h[o], doc[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(w) + 1))


def _set_ids(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that equal sets share: two sums of spread hashes."""
    out = []
    for k in (0xA24BAED4963EE407, 0x9FB21C651E98DF25):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(h * np.uint64(k)))))
        out.append((total[off[1:]] - total[off[:-1]]).view(np.int64))
    return out[0], out[1]


def _sub_keys(h: np.ndarray, start: np.ndarray, r: int, m: int, side: int) -> np.ndarray:
    """One row of ``m`` sub-keys per non-empty set; ``start``: where each set begins."""
    out = np.zeros((len(start), m), np.uint64)
    rng = mix64(np.arange(1, 2 * m * r + 1, dtype=np.uint64) + np.uint64(side << 32)) | np.uint64(1)
    for i in range(m):
        for j in range(r):
            f = 2 * (i * r + j)
            least = np.minimum.reduceat((h + rng[f + 1]) * rng[f], start)
            out[:, i] = mix64(out[:, i] * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, i] = mix64(out[:, i] + np.uint64(i))
    return out


def _signatures(size: int, r: int, m: int):
    def of(b: pa.RecordBatch):
        for i, j in slices(b.column(1)):
            w = words(b.column(1).slice(i, j - i))
            h, off = shingle_sets(w, size)
            n = np.diff(off)
            c1, c2 = _set_ids(h, off)
            full = n > 0
            start = off[:-1][full]
            keys = [lists((_sub_keys(h, start, r, m, side).view(np.int64) if len(start) else np.empty((0, m), np.int64)).ravel(), np.where(full, m, 0), pa.int64()) for side in (0, 1)]
            yield batch(_SIG, b.column(0).slice(i, j - i), n, c1, c2, *keys, b.column(2).slice(i, j - i))

    return of


def _sets(size: int, bits):
    def of(b: pa.RecordBatch):
        ids = b.column(0)
        some = pa.array(bitmap.test(bits.value, ids.to_numpy(zero_copy_only=False)))
        b = b.filter(some)
        for i, j in slices(b.column(1)):
            h, off = shingle_sets(words(b.column(1).slice(i, j - i)), size)
            c1, c2 = _set_ids(h, off)
            yield batch(_SET, b.column(0).slice(i, j - i), np.diff(off), c1, c2, lists(h.view(np.int64), np.diff(off), pa.int64()))

    return of


def _groups(batches, keys: int):
    """Tables of the rows that agree in the first ``keys`` columns; batches come sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        edge = np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(k)]))
        for a, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
            key = tuple(k[a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, e - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _linked(h: np.ndarray, row: np.ndarray, n: np.ndarray, threshold: int) -> np.ndarray:
    """Which pairs of a block of sets reach the threshold, as a square of booleans."""
    g = len(n)
    _, col, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = times[col] > 1
    row, col = row[shared], col[shared]
    names, col = np.unique(col, return_inverse=True)
    both = np.zeros((g, g), np.float32)
    step = max(1, _COLUMNS // max(g, 1))
    o = np.argsort(col, kind="stable")
    row, col = row[o], col[o]
    for a in range(0, len(names), step):
        i, j = np.searchsorted(col, [a, a + step])
        x = np.zeros((g, min(step, len(names) - a)), np.float32)
        x[row[i:j], col[i:j] - a] = 1
        both += x @ x.T
    both = np.rint(both).astype(np.int64)
    return 100 * both >= threshold * (n[:, None] + n[None, :] - both)


def _forest(link: np.ndarray, ids: np.ndarray):
    """Edges (smallest id, id) of each component of a block."""
    todo = np.ones(len(ids), bool)
    for i in np.argsort(ids, kind="stable"):
        if not todo[i]:
            continue
        comp = front = np.zeros(len(ids), bool)
        front[i] = True
        comp = front.copy()
        while front.any():
            front = link[front].any(axis=0) & ~comp
            comp |= front
        todo &= ~comp
        rest = ids[comp]
        yield from ((int(ids[i]), int(x)) for x in rest[rest != ids[i]])


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _verify(threshold: int):
    def run(batches):
        u, v = [], []
        for t in _groups(batches, 3):
            if t.num_rows < 2:
                continue
            ids, n = t["doc_id"].to_numpy(), t["n"].to_numpy()
            s = t["shingles"].combine_chunks()
            h = s.flatten().to_numpy()
            for x, y in _forest(_linked(h, np.repeat(np.arange(len(n)), n), n, threshold), ids):
                u.append(x)
                v.append(y)
            if len(u) > 50_000:
                yield batch(_EDGE, u, v)
                u, v = [], []
        if u:
            yield batch(_EDGE, u, v)

    return run


def _text_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def signatures(docs: DataFrame, doc_id: str, text: str, size: int, threshold: int, m: int = M) -> DataFrame:
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), _text_hash(text).alias("th"))
    return d.mapInArrow(arrow_stage(_signatures(size, minhashes(threshold), m)), "doc_id long, n long, c1 long, c2 long, a array<long>, b array<long>, th long")


def candidates(classes: DataFrame) -> DataFrame:
    """``u, v``: each class of a table's bucket with the smallest class there. Input: ``rep, a, b``."""

    def shared(keys: DataFrame) -> DataFrame:
        many = keys.groupBy("k").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
        return keys.join(many.select("k", "lo"), "k")

    def live(side: str) -> DataFrame:
        k = classes.select("rep", F.explode(side).alias("k"))
        return shared(k).groupBy("rep").agg(F.collect_set("k").alias(side))

    # m keys per class and side at most, so these lists are short
    pairs = live("a").join(live("b"), "rep").select("rep", F.explode("a").alias("x"), "b").select("rep", "x", F.explode("b").alias("y"))
    tables = shared(pairs.select("rep", F.xxhash64("x", "y").alias("k")))
    return tables.where("lo < rep").select(F.col("lo").alias("u"), F.col("rep").alias("v")).distinct()


def verified(docs: DataFrame, members: DataFrame, doc_id: str, text: str, size: int, threshold: int) -> DataFrame:
    """``u, v``: links that hold on full sets. ``members``: classes and their candidate groups (``rep, n, c1, c2, g``)."""
    spark = docs.sparkSession
    n = members.count()
    bits = spark.sparkContext.broadcast(bitmap.build(members, "rep", n))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    sets = d.mapInArrow(arrow_stage(_sets(size, bits)), "doc_id long, n long, c1 long, c2 long, shingles array<long>")
    sizes = members.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    placed = members.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # a block meets every other block of its group (and itself) once
    meets = placed.select("rep", "n", "c1", "c2", "g", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    meets = meets.select("c1", "c2", "n", F.col("rep").alias("doc_id"), "g", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    rows = sets.join(meets, ["doc_id", "n", "c1", "c2"]).select("g", "p", "q", "doc_id", "n", "shingles")
    return rows.repartition("g", "p", "q").sortWithinPartitions("g", "p", "q").mapInArrow(_verify(threshold), "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, threshold: int = 80, m: int = M) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row. ``threshold``: percent of the union that is shared."""
    return judged(docs, doc_id, text, size, threshold, m).drop("th")


def judged(docs: DataFrame, doc_id: str, text: str, size: int, threshold: int, m: int = M) -> DataFrame:
    """As ``near_duplicates``, with a hash of each row's text (``th``)."""
    sig = stored(signatures(docs, doc_id, text, size, threshold, m), "signatures")
    named = sig.where("doc_id IS NOT NULL")
    classes = named.where("n > 0").groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("rep"))
    reps = named.where("n > 0").join(classes, ["c1", "c2", "n"]).where("doc_id = rep")
    groups = graph.components(candidates(reps.select("rep", "a", "b")))
    grouped = groups.select(F.col("node").alias("rep"), F.col("root").alias("g")).union(groups.select(F.col("root").alias("rep"), F.col("root").alias("g")).distinct())
    members = stored(reps.select("rep", "n", "c1", "c2").distinct().join(grouped, "rep"), "members")
    roots = graph.components(verified(docs, members, doc_id, text, size, threshold))
    of_class = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("c1", "c2", "n", F.coalesce("root", "rep").alias("root"))
    out = named.select("doc_id", "n", "c1", "c2", "th").join(of_class, ["c1", "c2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"), "th")
    lost = sig.where("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), "th")
    out = out.unionByName(lost)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, threshold: int = 80) -> DataFrame:
    """Rows of ``docs`` (all columns) without near duplicates; rows without an id stay.

    Rows that repeat a doc_id are judged each by its own text: one goes where its text is a near
    copy of a smaller document's, and another with a text of its own stays. Of rows that
    repeat a kept doc_id and its text one stays.
    """
    spark = docs.sparkSession
    out = judged(docs, doc_id, text, size, threshold).where("doc_id IS NOT NULL")
    gone = stored(out.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_text")).distinct(), "dropped")
    again = stored(out.where("kept").groupBy("doc_id", "th").count().where("count > 1").select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_text")), "repeated")
    bits = spark.sparkContext.broadcast(bitmap.build(gone.union(again), "gone_id", gone.count() + again.count()))

    @F.arrow_udf("boolean")
    def maybe(ids: pa.Array) -> pa.Array:
        return pa.array(bitmap.test(bits.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False))

    id_ = F.col(doc_id).cast("long")
    names, rank = [fresh(docs.columns, n) for n in ("gone_id", "gone_text")], fresh(docs.columns, "row_rank")
    gone, again = gone.toDF(*names), again.toDF(*names)
    # only rows that may be dropped are exchanged
    sure = docs.where(~F.coalesce(maybe(id_), F.lit(False)))
    asked = docs.where(F.coalesce(maybe(id_), F.lit(False))).withColumns({names[0]: id_, names[1]: _text_hash(text)}).join(gone, names, "left_anti")
    single = asked.join(again, names, "left_anti")
    order = Window.partitionBy(*names).orderBy(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns))))
    many = asked.join(again, names, "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)
    return sure.unionByName(single.unionByName(many).drop(*names))
