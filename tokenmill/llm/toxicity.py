"""Toxicity by class-conditional Kneser-Ney models of word pairs with a shared backoff.

Each class counts, for every pair (history, word), its training documents that hold the
pair, so one text repeating itself counts once. The lower order is the continuation
count: the distinct histories of a word in the class. What it reserves goes to one shared
distribution, the distinct histories of a word in the whole corpus, labelled or not.

Interpolated, with absolute discounts: P(w) = kept(w) / n + rest * shared(w) and
P(w | h) = kept(h, w) / n(h) + rest(h) * P(w), where rest is the share the discounts leave,
so both are distributions. The discount of a count is a constant (``DISCOUNT``, ``PAIR_DISCOUNT``;
in the larger class as many times larger as the class is) and ``FACTOR`` times the count
that the other class leads one to expect. So a class keeps what it says several times as often as
the other, and language and topic, which it has by chance of its few documents, come from
the shared counts in both.

A document's two length-normalised log-likelihoods, mean ln P over all its words, are
compared: their difference is the evidence. Two numbers (slope and intercept) turn its root, with its
sign, into a probability; they are fitted on at most ``CALIBRATED`` documents of one training fold, judged
by models without it. The difference is added up from its parts: the same for every word,
what a kept word adds, what a history of kept pairs adds to each word after it, and what a
kept pair adds to its word and history. The parts that are zero are left out.

Most pairs stand in one document of the corpus only. A first pass finds those that stand
in two (``packed.in_two``); the others are added up by word inside the task and are never
exchanged as pairs.

Counts and parts are Spark tables by 64-bit word hashes and grow with the corpus; every
labelled row that is not held out is learnt from. Documents meet the parts in a join, but for a bounded number of the
most frequent ones, which tasks hold. One number is estimated (2^14 registers, 0.8 %): how
many pairs the corpus holds, which the shared counts are divided by.

Defined cases: null and empty texts score like texts of words that no class keeps;
labels without id or value are ignored and repeated ones count once (toxic if any says
so); with no training row of either class all scores are 0. Results are one per row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm import bitmap, packed
from tokenmill.llm.base import arrow_stage, batch, fresh, stored
from tokenmill.llm.words import ALNUM, Words, mix64, slices, words

CALIBRATED = 20_000  # training rows that slope and intercept are fitted on, at most
DISCOUNT = 2.0  # of a word's histories
PAIR_DISCOUNT = 8.0  # of a pair's documents; near copies share pairs (chosen on the training folds)
FACTOR = 5.0  # a class keeps a count beyond so many times what the other expects (chosen on the training folds)
REMAINDERS = 5  # of the id's hash; 0 is held out
FOLDS = 2  # training folds: remainder 1, which slope and intercept are fitted on, and 2 to 4
BROADCAST_LABELS = 2_000_000  # labelled rows (some 20 bytes each) up to which texts stay where they are; beyond, both sides are exchanged
PIECE = 1_000_000  # pairs a task adds up before it hands them on
REGISTERS = 14  # bits
FREQUENT = 1 << 17  # parts of the difference, at most, that tasks add up by themselves (24 bytes each); the others meet the texts in a join
SEEN_BYTES = 4  # of a history in the shared counts: of a million histories of a word some 100 agree in them
RARE = 1024  # bits of a bitmap for a word or pair that all texts are asked for
UNSEEN = float(1 << 18)  # shared counts kept for words that the corpus lacks; they decide in small tables only
_FOLLOW = pa.schema([("h", pa.int64()), ("slot", pa.int32()), ("n", pa.int64())])
_REGISTER_PARTS = 64
_HIT = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("words", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("sum0", pa.float64()), ("sum1", pa.float64())])
_HIT_SQL = "t1 long, t2 long, words long, key long, n long, sum0 double, sum1 double"
#: models: of all training folds, and without the one that is judged to fit the curve
_MODELS = range(2)
_SIDES = ("toxic", "ordinary")
_SLOTS = [f"{side}{f}" for side in _SIDES for f in range(1, FOLDS + 1)]


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(REMAINDERS))


def _label_rows(labels: DataFrame, doc_id: str, toxic: str) -> DataFrame:
    t = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    return t.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).withColumn("fold", F.least(fold_of(F.col("doc_id")), F.lit(FOLDS)).cast("int")).where("fold <> 0")


def _history(w: Words) -> np.ndarray:
    """The word before each word, as 48 bits of its hash; 0 at the start of a text."""
    h = np.zeros(len(w.hash), np.uint64)
    h[1:] = w.hash[:-1] >> np.uint64(64 - packed.HISTORY_BITS)
    h[w.offset[:-1][w.counts() > 0]] = 0
    return h


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(mix64(h + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xDA942042E4DD58B5) + w)


def history_key(h: np.ndarray) -> np.ndarray:
    return mix64(mix64(h + np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD1342543DE82EF95))


def _pair_keys(b: pa.RecordBatch):
    for i, j in slices(b.column(0)):
        w = words(b.column(0).slice(i, j - i), ALNUM)
        yield pair_key(_history(w), w.hash), w.text_of() + i


def _added(h: np.ndarray, slot: np.ndarray) -> pa.RecordBatch:
    """Rows that agree in history and slot as one with their number."""
    _, first, n = np.unique(mix64(h + slot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    return batch(_FOLLOW, h[first].view(np.int64), slot[first].astype(np.int32), n.astype(np.int64))


def _once_a_document(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """History, word and text of each pair, once a text."""
    h, doc = _history(w), w.text_of()
    one = np.unique(mix64(pair_key(h, w.hash) + doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), return_index=True)[1]
    return h[one], w.hash[one], doc[one]


def _histories(bits):
    """``h, slot, n``: how many pairs follow a word that is asked for, over documents."""

    def of(b: pa.RecordBatch):
        side = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in slices(b.column(0)):
            w = words(b.column(0).slice(i, j - i), ALNUM)
            if len(w.hash):
                h, _, doc = _once_a_document(w)
                some = bitmap.test(bits.value, h.view(np.int64))
                yield _added(h[some], side[i:j][doc[some]])

    return of


def _coded(w: np.ndarray, h: np.ndarray, slot: np.ndarray, lone: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, history and code (lone 1 bit, slot 2 bits, number 5 bits) of equal rows as one, or as several where they are over 31."""
    key = (w if lone else pair_key(h, w)) + slot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, first, n = np.unique(mix64(key), return_index=True, return_counts=True)
    full, rest = n // 31, n % 31
    times = full + (rest > 0)
    at = np.repeat(first, times)
    number = np.full(len(at), 31)
    last = np.cumsum(times) - 1
    number[last[rest > 0]] = rest[rest > 0]
    return w[at], h[at], (number | (slot[at] << 5) | (int(lone) << 7)).astype(np.uint8)


def _pairs(bits, twice_buckets: int, buckets: int):
    """Documents of a fold and class that hold a pair, packed; pairs of one document count for their word alone."""

    def flush(parts):
        w, h, slot = (np.concatenate(x) for x in zip(*parts))
        twice = bitmap.test(bits.value, packed.cut(pair_key(h, w), twice_buckets).view(np.int64))
        rows = _coded(w[twice], h[twice], slot[twice], False), _coded(w[~twice], h[~twice], slot[~twice], True)
        return packed.sets(*(np.concatenate(x) for x in zip(*rows)), buckets)

    def run(batches):
        parts, n = [], 0
        for b in batches:
            side = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in slices(b.column(0)):
                w = words(b.column(0).slice(i, j - i), ALNUM)
                if not len(w.hash):
                    continue
                h, word, doc = _once_a_document(w)
                parts.append((word, h, side[i:j][doc]))
                n += len(word)
                if n >= PIECE:
                    yield flush(parts)
                    parts, n = [], 0
        if n:
            yield flush(parts)

    return run


def _count_pairs(group: pa.Table) -> pa.Table:
    """``w, h`` and the sums by slot of a bucket; ``h`` is null for pairs of one document."""
    w, h, code = packed.unpacked(group, 7)
    lone = code >> 7
    h = np.where(lone == 1, np.uint64(0), h)  # their histories only spread them over the buckets
    order = np.lexsort((h, lone, w))
    w, h, lone, code = w[order], h[order], lone[order], code[order]
    at = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (h[1:] != h[:-1]) | (lone[1:] != lone[:-1]))))
    number, slot = (code & 31).astype(np.int64), (code >> 5) & 3
    sums = [pa.array(np.add.reduceat(np.where(slot == k, number, 0), at)) for k in range(2 * FOLDS)]
    return pa.table([pa.array(w[at].view(np.int64)), pa.array(h[at].view(np.int64), mask=lone[at] == 1), *sums], names=["w", "h", *_SLOTS])


def _seen(bits, buckets: int):
    """Histories of the words asked for, packed, and registers that estimate how many pairs there are (buckets below 0)."""

    def run(batches):
        register = np.zeros(1 << REGISTERS, np.uint8)
        found, n = [], 0
        for b in batches:
            for i, j in slices(b.column(0)):
                w = words(b.column(0).slice(i, j - i), ALNUM)
                if not len(w.hash):
                    continue
                h = _history(w)
                key, first = np.unique(pair_key(h, w.hash), return_index=True)
                rest = (key >> np.uint64(REGISTERS)).astype(np.float64)
                rank = 64 - REGISTERS + 1 - np.where(rest > 0, np.frexp(rest)[1], 0)
                np.maximum.at(register, (key & np.uint64((1 << REGISTERS) - 1)).astype(np.int64), rank.astype(np.uint8))
                some = bitmap.test(bits.value, w.hash[first].view(np.int64))
                found.append((key[some], w.hash[first[some]], h[first[some]]))
                n += int(some.sum())
                if n >= 2 * PIECE:
                    yield _distinct(found, buckets)
                    found, n = [], 0
        if n:
            yield _distinct(found, buckets)
        parts = register.reshape(_REGISTER_PARTS, -1)
        some = np.flatnonzero(parts.any(axis=1))
        empty = pa.array([b""] * len(some), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(-1 - some, pa.int32()), empty, empty, pa.array([parts[k].tobytes() for k in some], pa.binary())], names=["bucket", "words", "sizes", "entries"])

    return run


def _distinct(found, buckets: int) -> pa.RecordBatch:
    key, word, h = (np.concatenate(x) for x in zip(*found))
    first = np.unique(key, return_index=True)[1]
    return packed.sets(word[first], h[first], None, buckets, SEEN_BYTES)


def _count_seen(group: pa.Table) -> pa.Table:
    """``w, n``: distinct histories of each word in a bucket; without a word, register and rank in one number."""
    bucket = group.column("bucket")[0].as_py()
    if bucket < 0:
        rank = np.zeros((1 << REGISTERS) // _REGISTER_PARTS, np.uint8)
        for part in group.column("entries").to_pylist():
            np.maximum(rank, np.frombuffer(part, np.uint8), out=rank)
        at = np.flatnonzero(rank)
        return pa.table({"w": pa.nulls(len(at), pa.int64()), "n": pa.array(((at + (-1 - bucket) * len(rank)) << 8) | rank[at].astype(np.int64))})
    w, h, _ = packed.unpacked(group, SEEN_BYTES, SEEN_BYTES)
    order = np.lexsort((h, w))
    w, h = w[order], h[order]
    new = np.concatenate(([True], (w[1:] != w[:-1]) | (h[1:] != h[:-1])))
    at = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
    return pa.table({"w": pa.array(w[at].view(np.int64)), "n": pa.array(np.add.reduceat(new.astype(np.int64), at))})


def estimate(register: np.ndarray) -> float:
    """How many differ, from the largest rank of each register."""
    m = len(register)
    e = 0.7213 / (1 + 1.079 / m) * m * m / np.exp2(-register.astype(np.float64)).sum()
    empty = int((register == 0).sum())
    return m * np.log(m / empty) if e <= 2.5 * m and empty else e


def _hits(bits, frequent):
    """Words, pairs and histories of each text that may have a part in the difference; the frequent ones as their sums, without a key."""

    def run(b: pa.RecordBatch):
        t1, t2 = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        names, gains = frequent.value
        for i, j in slices(b.column(0)):
            w = words(b.column(0).slice(i, j - i), ALNUM)
            if not len(w.hash):
                continue
            h = _history(w)
            key, doc = np.concatenate((w.hash, pair_key(h, w.hash), history_key(h))).view(np.int64), np.tile(w.text_of(), 3)
            some = bitmap.test(bits.value, key)
            key, doc = key[some], doc[some]
            order = np.lexsort((key, doc))
            key, doc = key[order], doc[order]
            new = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (key[1:] != key[:-1])))) if len(key) else np.empty(0, np.int64)
            n = np.diff(np.append(new, len(key)))
            at, key = doc[new], key[new]
            place = np.searchsorted(names, key)
            known = place < len(names)
            known[known] = names[place[known]] == key[known]
            # added up in the order of the keys, so equal texts have equal sums
            sums = [np.bincount(at[known], weights=n[known] * gains[place[known], v], minlength=j - i) for v in _MODELS]
            own = np.flatnonzero(np.bincount(at[known], minlength=j - i))
            rest, none = at[~known], np.zeros(len(own), np.int64)
            zero = np.zeros(len(rest))
            yield batch(_HIT, t1[i:j][rest], t2[i:j][rest], w.counts()[rest], key[~known], n[~known], zero, zero)
            yield batch(_HIT, t1[i:j][own], t2[i:j][own], w.counts()[own], pa.nulls(len(own), pa.int64()), none, *(x[own] for x in sums))

    return run


def _root(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.sqrt(np.abs(x))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve (Newton steps with a slight ridge)."""
    scale = x.std() or 1.0
    z = np.column_stack((x / scale, np.ones(len(x))))
    w = np.array([0.0, np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])
    ridge = np.diag([1.0, 1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-9:
            break
    return max(w[0], 0.0) / scale, w[1]


@dataclass
class Model:
    """``t1, t2, x``: difference of the mean log-likelihoods of texts by their hashes, ``base`` of all others, and the curve it is judged by."""

    evidence: DataFrame
    slope: float = 0.0
    intercept: float = 0.0
    base: float = 0.0
    fitted: bool = True

    def score(self, x: Column) -> Column:
        if not self.fitted:
            return F.lit(0.0)
        x = F.coalesce(x, F.lit(float(self.base)))
        return F.lit(1.0) / (1 + F.exp(-(F.lit(float(self.slope)) * F.signum(x) * F.sqrt(F.abs(x)) + F.lit(float(self.intercept)))))

    def judges_base_toxic(self) -> bool:
        return self.fitted and self.slope * float(_root(np.float64(self.base))) + self.intercept >= 0


def _text_keys(text: str, names=("t1", "t2")) -> list[Column]:
    t = F.col(text).cast("string")
    return [F.xxhash64(t).alias(names[0]), F.xxhash64(F.lit(1), t).alias(names[1])]


def _of(side: str, v: int) -> str:
    """Documents of a class that hold a pair, in the folds of a model."""
    return "(" + " + ".join(f"{side}{f}" for f in range(1, FOLDS + 1) if f != v) + ")"


#: Sums of ``n`` by class and fold.
_BY_SLOT = [f"sum(IF(slot = {k}, n, 0L)) AS {name}" for k, name in enumerate(_SLOTS)]


def pair_counts(t: DataFrame) -> DataFrame:
    """``w, h`` with the documents of each class and fold that hold the pair; where ``h`` is null, pairs of ``w`` in one document. Input: ``text, slot``."""
    total = t.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    buckets = packed.buckets_for(total / 6)
    twice = stored(packed.in_two(t, _pair_keys, buckets), "toxic-twice")
    bits = t.sparkSession.sparkContext.broadcast(bitmap.build(twice, "k", twice.count()))
    parts = t.mapInArrow(_pairs(bits, buckets, packed.buckets_for(total / 12)), packed.SETS).groupBy("bucket")
    out = parts.applyInArrow(_count_pairs, "w long, h long, " + ", ".join(f"{c} long" for c in _SLOTS))
    out = stored(out, "toxic-pairs")
    bits.destroy()
    return out


def _kept(s: str, v: int, count: str, discount: float, total: dict[str, float]) -> str:
    """What a class keeps of a count: beyond the discount, and beyond ``FACTOR`` times what the other class expects."""
    other = _SIDES[1 - _SIDES.index(s)]
    size = total[f"{s}{v}"] / total[f"{other}{v}"]
    return f"greatest({count.format(s=s, v=v)} - {discount * max(1.0, size)!r}D - {FACTOR * size!r}D * {count.format(s=other, v=v)}, 0D)"


def parts(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, list[float]] | None:
    """``key, gain``: what a word, a pair and a history add to the difference in each model, and what every word adds.

    None where a class has no training row with words.
    """
    spark = docs.sparkSession
    t = rows.select("text", (F.col("fold") - 1 + F.lit(FOLDS) * (1 - F.col("toxic"))).cast("int").alias("slot"))
    counted = pair_counts(t)
    sides = [(s, v) for v in _MODELS for s in _SIDES]
    counts = counted.select("w", "h", *(F.expr(_of(s, v)).alias(f"c_{s}{v}") for s, v in sides))
    # continuation counts; pairs of one document are counted for their word already
    names = [f"{s}{v}" for s, v in sides]
    continued = [F.expr(f"IF(h IS NULL, c_{x}, least(c_{x}, 1L))").alias(f"n_{x}") for x in names]
    word_counts = counts.select("w", *continued)
    ends = counts.agg(*(F.sum(f"c_{x}") for x in names), *map(F.sum, continued)).collect()[0]
    of_pairs, of_words = ({k: float(x or 0) for k, x in zip(names, ends[i : i + len(names)])} for i in (0, len(names)))
    if not of_words["toxic0"] or not of_words["ordinary0"]:
        return None
    # the model that judges its own fold's rows may lack a class; then it keeps nothing
    models = [v for v in _MODELS if of_words[f"toxic{v}"] and of_words[f"ordinary{v}"]]

    def kept(table: DataFrame, keys: list[str], count: str, discount: float, total: dict[str, float]) -> DataFrame:
        own = table.select(*keys, *(F.expr(_kept(s, v, count, discount, total) if v in models else "0D").alias(f"k_{s}{v}") for s, v in sides))
        return own.where(" OR ".join(f"k_{x} > 0" for x in names))

    own = stored(kept(word_counts.groupBy("w").agg(*(F.sum(f"n_{x}").alias(f"n_{x}") for x in names)), ["w"], "n_{s}{v}", DISCOUNT, of_words), "toxic-words")
    held = stored(kept(counts.where("h IS NOT NULL"), ["h", "w"], "c_{s}{v}", PAIR_DISCOUNT, of_pairs), "toxic-held")
    sums = own.agg(*(F.sum(f"k_{x}") for x in names)).collect()[0]
    rest = {x: 1 - (k or 0.0) / of_words[x] if of_words[x] else 1.0 for x, k in zip(names, sums)}
    # what the histories of kept pairs leave to the lower order
    after = stored(held.groupBy("h").agg(*(F.sum(f"k_{x}").alias(f"k_{x}") for x in names)), "toxic-after")
    bits = spark.sparkContext.broadcast(bitmap.build(after, "h", after.count()))
    follow = t.mapInArrow(arrow_stage(_histories(bits)), "h long, slot int, n long").join(after.select("h"), "h", "left_semi").groupBy("h").agg(*map(F.expr, _BY_SLOT))
    follow = follow.select("h", *(F.expr(_of(s, v)).cast("double").alias(f"hn_{s}{v}") for s, v in sides))
    about = after.join(follow, "h").select("h", (F.col("hn_toxic0") + F.col("hn_ordinary0")).alias("often"), *(f"hn_{x}" for x in names), *(F.expr(f"IF(hn_{x} > 0, 1 - k_{x} / hn_{x}, 1D)").alias(f"rest_{x}") for x in names))
    about = stored(about, "toxic-histories")
    bits.destroy()
    asked = stored(own.select("w").union(held.select("w")).distinct(), "toxic-asked")
    # shared backoff: distinct histories in the whole corpus
    bits = spark.sparkContext.broadcast(bitmap.build(asked, "w", asked.count(), RARE))
    buckets = packed.buckets_for((docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0) / 12)
    seen = docs.select("text").mapInArrow(_seen(bits, buckets), packed.SETS).groupBy("bucket").applyInArrow(_count_seen, "w long, n long")
    seen = stored(seen, "toxic-seen")
    bits.destroy()
    ranks = seen.where("w IS NULL").selectExpr("shiftright(n, 8) AS at", "n & 255 AS r").toArrow()
    register = np.zeros(1 << REGISTERS, np.int64)
    register[ranks["at"].to_numpy()] = ranks["r"].to_numpy()
    shared = seen.join(asked, "w", "left_semi").groupBy("w").agg(F.sum("n").cast("double").alias("often")).withColumn("shared", F.col("often") / F.lit(estimate(register) + UNSEEN))
    lower = shared.join(own, "w", "left").select("w", "often", *(F.expr(f"coalesce(k_{x}, 0D) / {of_words[x] or 1.0!r}D + {rest[x]!r}D * shared").alias(f"p_{x}") for x in names))
    lower = stored(lower, "toxic-lower")
    base = [float(np.log(rest[f"toxic{v}"] / rest[f"ordinary{v}"])) for v in _MODELS]
    array = lambda part: "array(" + ", ".join(part.format(t=f"toxic{v}", o=f"ordinary{v}", base=repr(base[v])) for v in _MODELS) + ") AS gain"
    word, history = "ln(p_{t} / p_{o})", "ln(rest_{t} / rest_{o})"
    after_h = "(IF(hn_{0} > 0, k_{0} / hn_{0}, 0D) + rest_{0} * p_{0})"
    pair = f"ln({after_h.format('{t}')} / {after_h.format('{o}')}) - {word} - {history}"
    both = held.join(about.drop("often"), "h").join(lower.drop("often"), "w").selectExpr("h", "w", "k_toxic0 + k_ordinary0 AS often", array(pair))
    both = both.unionByName(about.selectExpr("h", "CAST(NULL AS long) AS w", "often", array(history)))

    def keyed(b):
        h, w = (b.column(k).fill_null(0).to_numpy().view(np.uint64) for k in (0, 1))
        key = np.where(b.column(1).is_null().to_numpy(zero_copy_only=False), history_key(h), pair_key(h, w))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(2), b.column(3)], names=["key", "often", "gain"])

    gain = lower.selectExpr("w AS key", "often", array(word + " - ({base}D)")).unionByName(both.mapInArrow(arrow_stage(keyed), "key long, often double, gain array<double>"))
    return stored(gain.where("exists(gain, x -> abs(x) > 1e-15)"), "toxic-gains"), base


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", calibrated: int = CALIBRATED) -> Model:
    """Learn both class models from the labelled rows that are not held out, the backoff from all documents; compare them on every text."""
    spark = docs.sparkSession
    rows = _label_rows(labels, "doc_id", toxic)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = stored(rows, "toxic-labels")
    n = rows.count()
    found = parts(d, d.join(F.broadcast(rows) if n <= BROADCAST_LABELS else rows, "doc_id"))
    if found is None:
        return Model(docs.limit(0).select(*_text_keys(text), F.lit(0.0).alias("x")), fitted=False)
    gain, base = found
    bits = spark.sparkContext.broadcast(bitmap.build(gain, "key", gain.count(), RARE))
    most = gain.orderBy(F.desc("often"), "key").limit(FREQUENT).select("key", *(F.col("gain")[v].alias(f"g{v}") for v in _MODELS)).toArrow().sort_by("key")
    frequent = spark.sparkContext.broadcast((most["key"].to_numpy(), np.column_stack([most[f"g{v}"].to_numpy() for v in _MODELS])))
    # equal texts give equal rows, so one is left of each
    hits = d.select("text", *_text_keys("text")).mapInArrow(arrow_stage(_hits(bits, frequent)), _HIT_SQL).distinct()
    hits = stored(hits, "toxic-hits")
    parted = hits.join(gain, "key").select("t1", "t2", "words", *(F.expr(f"n * gain[{v}]").alias(f"sum{v}") for v in _MODELS))
    summed = parted.unionByName(hits.where("key IS NULL").select("t1", "t2", "words", *(f"sum{v}" for v in _MODELS)))
    x = summed.groupBy("t1", "t2").agg(*((F.sum(f"sum{v}") / F.max("words") + F.lit(base[v])).alias(f"x{v}") for v in _MODELS))
    x = stored(x, "toxic-evidence")
    bits.destroy()
    frequent.destroy()
    few = rows.where("fold = 1")
    n = few.count()
    if n > calibrated:
        few = few.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < int((1 << 31) * calibrated / n))
    taught = d.select("doc_id", *_text_keys("text")).join(few, "doc_id").join(x, ["t1", "t2"], "left")
    taught = taught.select(F.coalesce("x1", F.lit(base[1])).alias("x"), F.col("toxic").cast("double").alias("y")).toArrow().sort_by([("x", "ascending"), ("y", "ascending")])
    evidence = x.select("t1", "t2", F.col("x0").alias("x"))
    if not taught.num_rows:
        return Model(evidence, fitted=False)
    slope, intercept = _calibrate(_root(taught["x"].to_numpy()), taught["y"].to_numpy())
    return Model(evidence, float(slope), float(intercept), base[0])


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    m = fit(docs, labels, doc_id, text)
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *_text_keys(text)).join(m.evidence, ["t1", "t2"], "left")
    out = out.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), m.score(F.col("x")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def remove(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` (all columns) that are not judged toxic."""
    m = fit(docs, labels, doc_id, text)
    all_gone = m.judges_base_toxic()  # then texts without kept words are toxic, too
    names = [fresh(docs.columns, n) for n in ("toxic_t1", "toxic_t2")]
    other = m.evidence.where((m.score(F.col("x")) >= 0.5) != F.lit(all_gone))
    other = stored(other.select(F.col("t1").alias(names[0]), F.col("t2").alias(names[1])), "toxic-texts")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap.build(other, names[0], other.count()))

    @F.arrow_udf("boolean")
    def maybe(t1: pa.Array) -> pa.Array:
        return pa.array(bitmap.test(bits.value, t1.to_numpy(zero_copy_only=False)))

    # only rows that may be judged otherwise than a text without kept words are exchanged
    first, second = _text_keys(text, names)
    asked = docs.where(maybe(first)).select("*", first, second).join(other, names, "left_semi" if all_gone else "left_anti").drop(*names)
    return asked if all_gone else docs.where(~maybe(first)).unionByName(asked)
