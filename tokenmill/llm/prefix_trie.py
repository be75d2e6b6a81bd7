"""Conversation prefix trie: shared openings as a tree, measured along its Euler tour.

A node is a distinct sequence of first turns; a conversation is a member of every node it
starts with. Keys of prefixes are exclusive-or sums of 64-bit turn hashes salted with the
position (two of them), so they come from window sums in blocks and a conversation of any
length needs no task of its own.

1. *Arcs.* Nodes stand in order of depth, parent and smallest member, so siblings are
   neighbours and a parent needs only its first and last child. Each node has an enter and an
   exit arc; together they form one list, the Euler tour.
2. *List ranking.* In each round an arc whose hash is smaller than both neighbours' leaves the
   list (a third of them, never two in a row) and its distance goes to its successor. What is
   left after some rounds, ``BASE`` arcs at most, is walked on the driver; then the arcs come
   back in reverse order, each behind its predecessor. All rounds are equal joins by arc.
3. *Prefix sums* over positions, in blocks of blocks, give leaves and savings of a subtree as
   the difference between its two arcs.
4. The ids that end on a node are hashed as a sorted stream; a run that crosses partitions
   is handed on in pieces of at most a megabyte, so no group is ever collected.

Hot first turns, parents and groups of copies are counted before they are exchanged or
meet unique rows in a join, which adaptive execution splits.

Defined cases: rows without conv_id take no part; a null role or text counts as empty, a null
turn comes first; equal turn numbers stand by role and text, and repeated rows are turns of
their own; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.llm.base import stored
from tokenmill.plans.numbering import index_by_order

BASE = 1 << 16  # arcs ranked on the driver
BLOCK = 4096  # rows of a window
PIECE = 1 << 20  # bytes of ids handed on at once
WORD = r"[^\x20\x09-\x0D]+"
_KEY = ["k1", "k2", "depth"]
_ENDS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("depth", pa.int64()), ("least", pa.int64()), ("sha", pa.string()), ("piece", pa.string())])
_SHA = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("depth", pa.int64()), ("sha", pa.string())])


# ---- turns


def ordered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, depth, t1, t2, words``: turns numbered from 1, with two hashes and a word count."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    t = t.where("conv_id IS NOT NULL").select(
        "*", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "role", "text").alias("t2"),
        F.size(F.regexp_extract_all("text", F.lit(WORD), 0)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"),
    )
    return index_by_order(t, ["turn", "role", "text", "row"], out="at", group_cols=["conv_id"]).select("conv_id", (F.col("at") + 1).alias("depth"), "t1", "t2", "words")


def with_openings(turns: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the opening of a neighbour: ``turns`` again, and their ``conv_id``.

    Conversation c takes the first h = crc32(c) mod (most + 1) turns of conversation
    c - c mod ``every``, and its own turns after its first h.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1)).cast("long")
    turns = stored(turns, "turns")
    ids = stored(turns.select("conv_id").distinct().select("conv_id", h.alias("h"), F.expr(f"conv_id - conv_id % {every}").alias("base")), "conversations")
    first = turns.where((F.expr(f"conv_id % {every}") == 0) & (F.col("depth") <= most)).withColumnRenamed("conv_id", "base")
    taken = stored(ids.join(first, "base").where("depth <= h").select("conv_id", "depth", "t1", "t2", "words"), "openings")
    n = taken.groupBy("conv_id").agg(F.count("*").alias("taken"))
    own = turns.join(ids.select("conv_id", "h"), "conv_id").where("depth > h").join(n, "conv_id", "left")
    own = own.select("conv_id", (F.col("depth") - F.col("h") + F.coalesce("taken", F.lit(0))).alias("depth"), "t1", "t2", "words")
    return taken.unionByName(own), ids.select("conv_id")


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2, p1, p2, words``: keys of each prefix and of the one before it."""
    t = turns.select("*", F.floor((F.col("depth") - 1) / BLOCK).alias("block"), F.xxhash64("depth", "t1", "t2").alias("a1"), F.xxhash64(F.lit(7), "depth", "t2", "t1").alias("a2"))
    here = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    blocks = t.groupBy("conv_id", "block").agg(F.bit_xor("a1").alias("b1"), F.bit_xor("a2").alias("b2"))
    so_far = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("conv_id", "block", F.bit_xor("b1").over(so_far).alias("b1"), F.bit_xor("b2").over(so_far).alias("b2")).where("block > 0")
    t = t.withColumns({f"x{i}": F.bit_xor(f"a{i}").over(here) for i in (1, 2)}).join(before, ["conv_id", "block"], "left")
    key = {i: F.col(f"x{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))) for i in (1, 2)}
    return t.select("conv_id", "depth", key[1].alias("k1"), key[2].alias("k2"), key[1].bitwiseXOR(F.col("a1")).alias("p1"), key[2].bitwiseXOR(F.col("a2")).alias("p2"), "words")


# ---- the tour


def tour(nodes: DataFrame) -> DataFrame:
    """``arc, next``: arcs 2 i (enter) and 2 i + 1 (exit) of node ``at`` = i; the root's exit has no next.

    ``nodes``: ``at`` with the ``first`` and ``last`` of its children, null where it has none.
    """
    down = nodes.select((F.col("at") * 2).alias("arc"), F.coalesce(F.col("first") * 2, F.col("at") * 2 + 1).alias("next"))
    up = nodes.where("last IS NOT NULL").select((F.col("last") * 2 + 1).alias("arc"), (F.col("at") * 2 + 1).alias("next"))
    # a child that is not the last one is followed by its neighbour
    across = nodes.where("at > 0").join(nodes.where("last IS NOT NULL").select(F.col("last").alias("at")), "at", "left_anti").select((F.col("at") * 2 + 1).alias("arc"), (F.col("at") * 2 + 2).alias("next"))
    return down.unionByName(up).unionByName(across).unionByName(nodes.where("at = 0").select(F.lit(1).cast("long").alias("arc"), F.lit(None).cast("long").alias("next")))


def list_ranks(arcs: DataFrame, base: int = BASE) -> DataFrame:
    """``arc, pos``: the place of each arc in its list, from 0. Input: ``arc, next`` of one list."""
    spark = arcs.sparkSession
    both = arcs.select("arc", "next", F.lit(None).cast("long").alias("prev")).unionByName(arcs.where("next IS NOT NULL").select(F.col("next").alias("arc"), F.lit(None).cast("long").alias("next"), F.col("arc").alias("prev")))
    left = stored(both.groupBy("arc").agg(F.max("next").alias("next"), F.max("prev").alias("prev")).withColumn("w", F.lit(1).cast("long")), "tour")
    gone: list[DataFrame] = []
    n = left.count()
    while n > base:
        h = lambda c: F.xxhash64(F.lit(len(gone)), F.col(c))  # noqa: E731, B023
        inner = F.col("prev").isNotNull() & F.col("next").isNotNull()  # both ends of the list stay
        marked = stored(left.withColumn("out", inner & (h("arc") < h("prev")) & (h("arc") < h("next"))), "tour-round")
        out = marked.where("out").select("arc", "next", "prev", "w")
        none = F.lit(None).cast("long")
        kept = marked.where("NOT out").select("arc", "next", "prev", "w", none.alias("next2"), none.alias("prev2"))
        say_prev = out.select(F.col("prev").alias("arc"), none.alias("next"), none.alias("prev"), F.lit(0).cast("long").alias("w"), F.col("next").alias("next2"), none.alias("prev2"))
        say_next = out.select(F.col("next").alias("arc"), none.alias("next"), none.alias("prev"), "w", none.alias("next2"), F.col("prev").alias("prev2"))
        new = kept.unionByName(say_prev).unionByName(say_next).groupBy("arc").agg(
            F.coalesce(F.max("next2"), F.max("next")).alias("next"), F.coalesce(F.max("prev2"), F.max("prev")).alias("prev"), F.sum("w").alias("w"))
        gone.append(out.select("arc", "prev", "w"))
        left = stored(new, "tour")
        n = left.count()
    # a bounded rest is walked here
    rest = {a: (b, w) for a, b, w in zip(*(c.to_pylist() for c in left.select("arc", "next", "w").toArrow().columns))}
    inner = {b for b, _ in rest.values()}
    here, at, pos, order = next((a for a in rest if a not in inner), None), 0, [], []
    while here is not None:
        nxt, w = rest[here]
        order.append(here)
        at += w if len(order) > 1 else 0
        pos.append(at)
        here = nxt
    ranks = stored(spark.createDataFrame(pa.table({"arc": pa.array(order, pa.int64()), "pos": pa.array(pos, pa.int64())})), "ranks")
    for out in reversed(gone):
        back = out.join(ranks.select(F.col("arc").alias("prev"), "pos"), "prev").select("arc", (F.col("pos") + F.col("w")).alias("pos"))
        ranks = stored(ranks.unionByName(back), "ranks")
    return ranks


def sums_before(rows: DataFrame, pos: str, values: list[str], n: int, block: int = BLOCK) -> DataFrame:
    """``pos`` and, of each value, its sum over smaller positions (dense from 0, ``n`` of them)."""
    rows = rows.select(pos, *values)
    if n <= block:
        w = Window.partitionBy(F.lit(0)).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)  # at most one block
        return rows.select(pos, *(F.coalesce(F.sum(v).over(w), F.lit(0)).alias(v) for v in values))
    up = f"{pos}_block"
    rows = rows.withColumn(up, F.floor(F.col(pos) / block))
    totals = rows.groupBy(up).agg(*(F.sum(v).alias(v) for v in values))
    above = sums_before(totals, up, values, -(-n // block), block).select(up, *(F.col(v).alias(f"{v}_above") for v in values))
    w = Window.partitionBy(up).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select(pos, up, *(F.coalesce(F.sum(v).over(w), F.lit(0)).alias(v) for v in values))
    return own.join(above, up).select(pos, *((F.col(v) + F.col(f"{v}_above")).alias(v) for v in values))


# ---- ids that end on a node


def _pieces(batches):
    """Ids of each node from a stream sorted by node and id: a hash where the node lies inside the partition, else pieces."""
    key, held, size, least, inside = None, [], 0, None, False

    def row(sha, piece):
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, least, sha, piece), _ENDS)], schema=_ENDS)

    for b in batches:
        if not b.num_rows:
            continue
        k = np.column_stack([b.column(i).to_numpy() for i in range(3)])
        ids = b.column(3).to_numpy()
        first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(axis=1))))
        done = [[] for _ in _ENDS]
        for i, j in zip(first.tolist(), np.append(first[1:], len(ids)).tolist()):
            now = tuple(k[i].tolist())
            if now != key:
                if key is not None:
                    if inside:
                        for column, x in zip(done, (*key, least, hashlib.sha256(",".join(held).encode()).hexdigest(), None)):
                            column.append(x)
                    else:
                        yield row(None, ",".join(held))
                    inside = True  # only the first and the last node of a partition may go on in another one
                key, held, size, least = now, [], 0, int(ids[i])
            for a in range(i, j, 20_000):
                part = [str(x) for x in ids[a : min(j, a + 20_000)].tolist()]
                if size > PIECE:
                    yield row(None, ",".join(held))
                    held, size, inside, least = [], 0, False, int(ids[a])
                held += part
                size += sum(map(len, part)) + len(part)
        if done[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(done, _ENDS)], schema=_ENDS)
    if key is not None:
        yield row(None, ",".join(held))


def _hashed(batches):
    """One hash a node from its pieces, sorted by node and id."""
    key, sha = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, sha.hexdigest()), _SHA)], schema=_SHA)

    for b in batches:
        for *now, piece in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 5))):
            if now != key:
                if key is not None:
                    yield row()
                key, sha = now, hashlib.sha256(piece.encode())
            else:
                sha.update(b"," + piece.encode())
    if key is not None:
        yield row()


def ends_hash(ends: DataFrame) -> DataFrame:
    """``k1, k2, depth, sha``: hash of the ids that end on a node, ascending and joined by commas."""
    parts = ends.select(*_KEY, "conv_id").repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    parts = stored(parts.mapInArrow(_pieces, "k1 long, k2 long, depth long, least long, sha string, piece string"), "ends")
    rest = parts.where("sha IS NULL").repartition(*_KEY).sortWithinPartitions(*_KEY, "least").mapInArrow(_hashed, "k1 long, k2 long, depth long, sha string")
    return parts.where("sha IS NOT NULL").select(*_KEY, "sha").unionByName(rest)


# ---- the operator


def trie(turns: DataFrame, conversations: DataFrame, base: int = BASE, block: int = BLOCK) -> DataFrame:
    """One row per node. ``turns``: ``conv_id, depth, t1, t2, words``; ``conversations``: every ``conv_id``, turnless ones, too."""
    rows = stored(prefixes(turns), "prefixes")
    whole = conversations.agg(F.min("conv_id"), F.count("*")).collect()[0]
    if not whole[1]:
        return rows.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    least, n_all = int(whole[0]), int(whole[1])
    nodes = stored(rows.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("words").alias("words")), "nodes")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"))
    columns = [*_KEY, "conv_id", "n_convs", "words", "parent"]
    below = nodes.where("depth > 1").join(parents, ["p1", "p2", "depth"]).select(*columns)
    top = nodes.where("depth = 1").withColumn("parent", F.lit(least).cast("long")).select(*columns)
    root = rows.sparkSession.createDataFrame([(0, 0, 0, least, n_all, 0, None)], "k1 long, k2 long, depth long, conv_id long, n_convs long, words long, parent long")
    all_ = stored(index_by_order(below.unionByName(top).unionByName(root), ["depth", "parent", "conv_id"], out="at"), "numbered")
    # siblings are neighbours in this order
    families = all_.where("depth > 0").groupBy("parent", "depth").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n_children"))
    families = families.select(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth"), "first", "last", "n_children")
    all_ = stored(all_.join(families, ["conv_id", "depth"], "left"), "families")
    ranks = list_ranks(tour(all_.select("at", "first", "last")), base)
    value = all_.select("at", F.col("first").isNull().cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    arcs = value.select((F.col("at") * 2).alias("arc"), "leaves", "saved").unionByName(value.select((F.col("at") * 2 + 1).alias("arc"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")))
    placed = stored(arcs.join(ranks, "arc"), "placed")
    sums = sums_before(placed, "pos", ["leaves", "saved"], 2 * all_.count(), block).join(placed.select("pos", "arc"), "pos")
    # what lies between entering a node and leaving it
    sign = F.when(F.col("arc") % 2 == 1, 1).otherwise(-1)
    measured = sums.groupBy(F.shiftright("arc", 1).alias("at")).agg(F.sum(sign * F.col("leaves")).alias("n_leaves"), F.sum(sign * F.col("saved")).alias("saved_tokens"))
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("m"))
    zero = F.lit(0).cast("long")
    last = conversations.join(last, "conv_id", "left").select("conv_id", F.coalesce("m.k1", zero).alias("k1"), F.coalesce("m.k2", zero).alias("k2"), F.coalesce("m.depth", zero).alias("depth"))
    out = all_.join(measured, "at").join(ends_hash(last), _KEY, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(nothing)).alias("ends_sha256"))
