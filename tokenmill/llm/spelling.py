"""Spelling variants: words one edit apart, by a frontier of trie states.

A trie of all words is a table of edges; chains without a branch or a word's end are one edge
with a label. The frontier holds states (word, position, node, edits). In each round
all states meet the edges of their node in one join: a state without an edit walks on
along its own word, and at every other edge it may replace or skip the character at its
position; a state with one edit walks only where the label agrees. A state at the end of its
word with one edit, on a node where a word ends, is a pair of neighbours. Rounds end when
no state is left: as many as there are branching nodes on the longest path.

An edit lies in the first or in the second half of a word, so the other half agrees. Two tries
are walked, of the words and of the words turned round; in each a state starts below the
half that agrees, where few words share a node. A pair is walked once: replacements towards
the larger character, and of two words of different length the longer one skips. Nodes
carry 64-bit hashes of their path; a last exact check of each pair makes collisions harmless.

Words are counted by task before they are exchanged, and no group of rows by word, node
or document is ever collected: hot nodes are skewed join keys, which adaptive execution splits.
No join broadcasts a side that grows with the words (see ``_join``).

Defined cases: null and empty texts have no words; a null doc_id is written as an empty
string where the doc_id takes part in the hash; rows that repeat count again; words of any
length are walked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.llm.base import arrow_stage, lists, stored
from tokenmill.llm.suffixes import Hashed
from tokenmill.llm.words import _powers, buffers, mix64, slices
from tokenmill.plans.numbering import index_by_order

LEAST_LENGTH, LEAST_COUNT = 5, 3
DAMAGE = 97  # one run in so many loses a character
COUNTED = 200_000  # distinct words a task holds before it hands their counts on

_U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def _join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the words: exchanged and merged, never broadcast.

    Spark sizes what comes out of ``mapInArrow`` and ``posexplode`` by the columns alone (a list of nodes counts as one) and a
    written table by its compressed files, so it would send tables of any size through the driver.
    """
    return left.join(right.hint("merge"), on, how)


# ---- words and how often they occur


def _runs(raw: np.ndarray, off: np.ndarray):
    """Lower-cased bytes, and start and end of each maximal run of A-Z, a-z and U+00C0 to U+00FF."""
    low = _LOWER[raw]
    lead = raw == 0xC3  # the first of the two bytes of U+00C0 to U+00FF
    inside = _LETTER[raw] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    return low, np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _crc(state: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 continued from ``state`` over byte ranges."""
    crc = state ^ np.uint32(0xFFFFFFFF)
    todo = np.arange(len(start))
    for k in range(64):
        todo = todo[start[todo] + k < end[todo]]
        if not len(todo):
            return crc ^ np.uint32(0xFFFFFFFF)
        c = crc[todo]
        crc[todo] = _CRC[(c ^ low[start[todo] + k]) & np.uint32(255)] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in todo:  # long runs
        crc[i] = zlib.crc32(low[start[i] + 64 : end[i]].tobytes(), int(crc[i]))
    return crc


def _slice_words(ids: list, raw: np.ndarray, off: np.ndarray, least: int):
    """Bytes, start and end of words (damaged ones apart, as bytes) of a few texts; too short ones left out."""
    low, start, end = _runs(raw, off)
    leads = np.concatenate(([0], np.cumsum(low == 0xC3, dtype=np.int32)))
    long = end - start - (leads[end] - leads[start]) >= least
    start, end = start[long], end[long]
    if not len(start):
        return low, start, end, []
    seed = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    crc = _crc(seed[np.searchsorted(off, start, "right") - 1], low, start, end)
    hit = crc % np.uint32(DAMAGE) == 0
    damaged = []
    for s, e, h in zip(start[hit], end[hit], crc[hit]):
        word = low[s:e].tobytes().decode()
        k = int(h) % len(word)
        if len(word) > least:
            damaged.append((word[:k] + word[k + 1 :]).encode())
    return low, start[~hit], end[~hit], damaged


def _counted(least: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for b in batches:
            ids = b.column(0).to_pylist()
            for i, j in slices(b.column(1)):
                raw, off = buffers(b.column(1).slice(i, j - i))
                low, start, end, damaged = _slice_words(ids[i:j], raw, off, least)
                if len(start):
                    _, first, n = np.unique(Hashed(low).ranges(start, end), return_index=True, return_counts=True)
                    for s, e, c in zip(start[first].tolist(), end[first].tolist(), n.tolist()):
                        w = low[s:e].tobytes()
                        counts[w] = counts.get(w, 0) + c
                for w in damaged:
                    counts[w] = counts.get(w, 0) + 1
                if len(counts) >= COUNTED:
                    yield flush()
        if counts:
            yield flush()

    return run


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of all words long and frequent enough."""
    t = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = t.mapInArrow(_counted(least_length), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---- the trie


def _hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all prefixes of each word, the empty one first, and how many each word has."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    c = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(_U) + _U(1)
    start = np.cumsum(size) - size
    place = np.arange(len(c)) - np.repeat(start, size)
    c = mix64(c * _U(0x9E3779B97F4A7C15)) * _powers(0xDA942042E4DD58B5, int(size.max(initial=0)) + 1)[place]
    total = np.concatenate((np.zeros(1, _U), np.cumsum(c)))
    n = size + 1
    first = np.repeat(start, n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return mix64(total[first + step] - total[first] + step.astype(_U) * _U(0xD1342543DE82EF95)).view(np.int64), n


def _prefix_hashes(b: pa.RecordBatch):
    """Of each row's word: the hashes of its prefixes; the last one is the word's own."""
    h, n = _hashes(b.column(1).to_pylist())
    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(h[np.cumsum(n) - 1]), lists(h, n, pa.int64())], names=["side", "word", "wid", "nodes"])


def _both_ways(words: DataFrame) -> DataFrame:
    """``side, word, wid, nodes``: every word and every word turned round, with the hashes of their prefixes."""
    sides = words.select(F.lit(0).alias("side"), "word").unionByName(words.select(F.lit(1).alias("side"), F.reverse("word").alias("word")))
    return sides.mapInArrow(arrow_stage(_prefix_hashes), "side int, word string, wid long, nodes array<long>")


def trie(words: DataFrame, low: int) -> tuple[DataFrame, DataFrame]:
    """Edges ``side, node, first, label, child, ends`` from depth ``low`` on, and start states ``side, word, pos, node, ends``.

    ``side`` 0 is the trie of the words, 1 that of the words turned round. A node stands where a
    word ends or two words part; ``label`` is the path from ``node`` to ``child``, ``first``
    its first character, ``ends`` tells whether a word ends at ``child``. Paths carry a word's hash
    and not the word, so a very long word costs a row a character.
    """
    sides = _both_ways(words)
    spelt = stored(sides.select("side", "word", "wid"), "trie-words")
    order = index_by_order(spelt.select("side", "word"), ["side", "word"], out="at")
    nxt = order.select((F.col("at") - 1).alias("at"), F.col("side").alias("s2"), F.col("word").alias("w2"))
    # where a word and its neighbour in order part, a node stands
    parting = F.arrow_udf(_parting, "long")
    branch = _join(order, nxt, "at").where("side = s2").select("side", parting("word", "w2").alias("node"), F.lit(False).alias("ends"))
    nodes = spelt.select("side", F.col("wid").alias("node"), F.lit(True).alias("ends")).unionByName(branch).groupBy("side", "node").agg(F.bool_or("ends").alias("ends"))
    n = F.size("nodes") - 1
    half = F.when(F.col("side") == 0, F.floor(n / 2)).otherwise(n - F.floor(n / 2)).cast("int")
    paths = sides.select("side", "wid", half.alias("half"), F.posexplode("nodes").alias("pos", "node")).where(F.col("pos") >= low)
    explicit = stored(_join(paths, nodes, ["side", "node"]), "trie-nodes")
    w = Window.partitionBy("side", "wid").orderBy("pos")
    steps = explicit.select("side", "wid", "node", "pos", F.lead("pos").over(w).alias("pos2"), F.lead("node").over(w).alias("child"), F.lead("ends").over(w).alias("ends")).where("child IS NOT NULL")
    edges = steps.groupBy("side", "node", "child").agg(F.min(F.struct("wid", "pos", "pos2")).alias("by"), F.bool_or("ends").alias("ends"))
    edges = _join(edges.select("side", "node", "child", "ends", "by.wid", "by.pos", "by.pos2"), spelt, ["side", "wid"])
    edges = edges.select("side", "node", "child", "ends", F.expr("substring(word, pos + 1, pos2 - pos)").alias("label"))
    edges = stored(edges.withColumns({"first": F.substring("label", 1, 1), "bit": F.expr("shiftleft(1L, ascii(label) % 63)")}), "trie-edges")
    # which characters may follow behind a child: most states that cannot go on are never made
    follow = edges.groupBy("side", F.col("node").alias("child")).agg(F.bit_or("bit").alias("follow"))
    edges = stored(_join(edges.drop("bit"), follow, ["side", "child"], "left").withColumn("follow", F.coalesce("follow", F.lit(0).cast("long"))), "trie-follow")
    start = explicit.where("pos >= half").groupBy("side", "wid").agg(F.min(F.struct("pos", "node", "ends")).alias("s"))
    return edges, _join(start, spelt, ["side", "wid"]).select("side", "word", "s.pos", "s.node", "s.ends")


def _parting(a: pa.Array, b: pa.Array) -> pa.Array:
    """Hash of the longest common prefix of two words."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        n = min(len(x), len(y))
        k = 0
        while k < n and x[k : k + 64] == y[k : k + 64]:
            k += 64
        k = min(k, n)
        while k < n and x[k] == y[k]:
            k += 1
        out.append(x[:k])
    h, n = _hashes(out)
    return pa.array(h[np.cumsum(n) - 1])


# ---- the frontier


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """All states one edge further."""
    e = edges.select("side", "node", "child", "label", "first", F.col("ends").alias("ends2"), "follow").hint("shuffle_hash")
    n = "char_length(label)"
    # a target is behind the child, or it is the child and a word ends there
    may = lambda pos: f"IF({pos} = char_length(word), ends2, follow & shiftleft(1L, ascii(substring(word, {pos} + 1, 1)) % 63) <> 0)"
    own = f"substring(word, pos + 1, {n}) = label AND (edits = 0 OR {may(f'pos + {n}')})"
    # a character replaced by a larger one; a character skipped, the last one of its kind in a row
    other = f"edits = 0 AND first > substring(word, pos + 1, 1) AND substring(word, pos + 2, {n} - 1) = substring(label, 2) AND pos + {n} <= char_length(word) AND {may(f'pos + {n}')}"
    skip = f"edits = 0 AND first <> substring(word, pos + 1, 1) AND substring(word, pos + 2, {n}) = label AND {may(f'pos + 1 + {n}')}"
    moves = F.expr(f"""array(
        IF({own}, named_struct('pos', pos + {n}, 'edits', edits), NULL),
        IF({other}, named_struct('pos', pos + {n}, 'edits', 1), NULL),
        IF({skip}, named_struct('pos', pos + 1 + {n}, 'edits', 1), NULL))""")
    out = states.where("pos < char_length(word)").join(e, ["side", "node"]).where(f"({own}) OR ({other}) OR ({skip})")
    out = out.select("side", "word", F.explode(moves).alias("m"), F.col("child").alias("node"), F.col("ends2").alias("ends")).where("m IS NOT NULL")
    return out.select("side", "word", F.col("m.pos").alias("pos"), "node", "ends", F.col("m.edits").alias("edits"))


def near_pairs(words: DataFrame, least_length: int = 0) -> DataFrame:
    """``a, b``: words with exactly one character inserted, deleted or replaced between them, both ways.

    ``words`` are distinct and have ``least_length`` characters or more.
    """
    edges, start = trie(words.select("word"), least_length // 2)
    spells = stored(start.select("side", "word", "pos", "node", "ends", F.lit(0).alias("edits")), "frontier")
    found = []
    while not spells.isEmpty():
        # ends are read before the next step: the whole word with one edit, or all but its last character
        found.append(spells.where("ends AND ((edits = 1 AND pos = char_length(word)) OR (edits = 0 AND pos = char_length(word) - 1))").select("side", "word", "node"))
        spells = stored(_step(spells, edges).where("edits = 0 AND pos < char_length(word) OR edits = 1"), "frontier")
    # the word that ends on a node, by its hash
    ends = _both_ways(words).select("side", F.col("wid").alias("node"), F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")).alias("b"))
    if not found:
        return words.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    pairs = _join(hits, ends, ["side", "node"]).select(F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")).alias("a"), "b")
    pairs = pairs.where((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word.

    ``form`` is the most frequent near word (ties: the smallest) that is at least twice as
    frequent; ``root`` is where forms lead in the end. Counts double at each form, so few
    rounds of pointer doubling reach it.
    """
    words = stored(word_counts(docs, doc_id, text, least_length, least_count), "spellings")
    pairs = stored(near_pairs(words, least_length), "spelling-pairs")
    near = _join(pairs, words.select(F.col("word").alias("b"), F.col("n").alias("bn")), "b")
    best = near.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("bn")).alias("k"), "b")).alias("m"))
    out = _join(words, best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("m.k") >= 2 * F.col("n"), F.col("m.b")).alias("form"), F.when(-F.col("m.k") >= 2 * F.col("n"), -F.col("m.k")).alias("form_n"))
    out = stored(out, "spelling-forms")
    links = stored(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        nxt = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        far = stored(_join(links, nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        links = far.select("word", "root")
        if far.where("moved").isEmpty():
            break
    return _join(out, links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
