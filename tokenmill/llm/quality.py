"""Quality by a weak-label model: heuristic labellers, expectation-maximisation, hashed linear scorer.

1. Each labeller looks at one trait of a whole text and votes good, bad or nothing. Votes
   form a pattern; the corpus is reduced to the count of each pattern (at most 3 to the
   power of the number of labellers, whatever the corpus).
2. Expectation-maximisation over the pattern counts estimates the share of good texts
   and, for each labeller, how it votes on good and on bad ones. No label is read.
3. The posterior of a text's pattern is its weak label. A linear scorer over hashed byte
   trigrams learns the posteriors of at most ``TAUGHT`` texts (chosen by a hash of the id) by
   full-gradient steps whose sums come from the tasks; then it scores every whole text.

Defined cases: null and empty texts get one vote (bad) and the score of the intercept;
with one kind of pattern only, posteriors are the prior; results are one per row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.base import arrow_stage, batch, stored
from tokenmill.llm.words import SPACED, buffers, mix64, slices, words

BUCKETS = 1 << 14
TAUGHT = 20_000  # texts that the scorer learns from at most
STEPS = 24
RATE, RIDGE = 0.25, 1e-5
ROUNDS = 200  # of expectation-maximisation at most; it stops earlier once it stands still
FALSE_ALARM = 0.01  # share of good texts that a labeller may call bad, at most
GOOD, BAD, SILENT = 2, 1, 0

_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "#%&*$!|<>{}~^\\"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\"'"]] = True


def _share_of(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[off[1:]] - total[off[:-1]]


def _voted(x: np.ndarray, good, bad, asked) -> np.ndarray:
    return np.where(asked, np.where(good(x), GOOD, np.where(bad(x), BAD, SILENT)), SILENT)


def votes(texts: pa.Array) -> np.ndarray:
    """One row per text, one column per labeller."""
    w = words(texts, SPACED, lower=False)
    raw, off = buffers(texts)
    n = w.counts()
    per = np.maximum(n, 1)
    some = n > 0
    marked = _share_of(_MARK[raw[w.end - 1]] if len(w.end) else np.empty(0, bool), w.offset) / per
    letters = np.maximum(_share_of(_LETTER[raw], off), 1)
    upper = _share_of(_UPPER[raw], off) / letters
    length = _share_of(w.end - w.start, w.offset) / per
    bare = _share_of((w.end - w.start == 1) & ~_LETTER[raw[w.start]] if len(w.start) else np.empty(0, bool), w.offset) / per
    # how much of a text its most frequent word makes up, and how many of its lines differ
    top, lines, ends = np.zeros(len(w)), np.ones(len(w)), np.ones(len(w))
    count = np.ones(len(w))
    for k in range(len(w)):
        a, b = w.offset[k], w.offset[k + 1]
        if a < b:
            top[k] = np.unique(w.hash[a:b], return_counts=True)[1].max() / (b - a)
        body = raw[off[k] : off[k + 1]].tobytes().strip()
        if body:
            ls = [x.strip() for x in body.split(b"\n")]
            ls = [x for x in ls if x]
            count[k], lines[k] = len(ls), len(set(ls)) / len(ls)
            ends[k] = sum(_STOP[x[-1]] for x in ls) / len(ls)
    many = n >= 10
    columns = [
        _voted(marked, lambda x: x <= 0.02, lambda x: x >= 0.2, some),
        _voted(upper, lambda x: x <= 0.15, lambda x: x >= 0.5, some),
        _voted(length, lambda x: (x >= 2.5) & (x <= 16), lambda x: (x < 2) | (x > 25), some),
        _voted(bare, lambda x: x <= 0.02, lambda x: x >= 0.2, some),
        _voted(top, lambda x: x <= 0.15, lambda x: x >= 0.3, many),
        _voted(lines, lambda x: x >= 0.95, lambda x: x <= 0.6, count >= 3),
        _voted(ends, lambda x: x >= 0.6, lambda x: x <= 0.2, some),
        np.where(some, SILENT, BAD),
    ]
    return np.column_stack(columns).astype(np.int64)


N_VOTERS = 8
_POWERS = 3 ** np.arange(N_VOTERS)


def _patterns(b: pa.RecordBatch):
    schema = pa.schema([("pattern", pa.int32()), ("n", pa.int64())])
    got = np.zeros(3**N_VOTERS, np.int64)
    for i, j in slices(b.column(0)):
        got += np.bincount(votes(b.column(0).slice(i, j - i)) @ _POWERS, minlength=len(got))
    some = np.flatnonzero(got)
    yield batch(schema, some.astype(np.int32), got[some])


def _digits(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // _POWERS % 3


def weigh(pattern: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float, np.ndarray]:
    """(posterior that each pattern is good, share of good texts, how each labeller votes on texts of each class).

    Faults come in kinds that different labellers see, so besides the class begun with the
    patterns that nobody calls bad there is one for each labeller, begun with those it does.
    """
    v = _digits(pattern)
    bad = (v == BAD).astype(float)
    member = np.column_stack((bad.sum(axis=1) == 0, bad)) + 1e-3
    member /= member.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        share = (member * n[:, None]).sum(axis=0) + 1e-3
        share /= share.sum()
        log = np.tile(np.log(share), (len(n), 1))
        rates = np.zeros((len(share), v.shape[1], 3))
        for c in range(len(share)):
            for j in range(v.shape[1]):
                rates[c, j] = np.bincount(v[:, j], weights=member[:, c] * n, minlength=3) + 0.1
                rates[c, j] /= rates[c, j].sum()
                if c == 0 and rates[c, j, BAD] > FALSE_ALARM:  # else one class could explain everything by chance
                    rates[c, j] *= (1 - FALSE_ALARM) / (1 - rates[c, j, BAD])
                    rates[c, j, BAD] = FALSE_ALARM
                log[:, c] += np.log(rates[c, j][v[:, j]])
        new = np.exp(log - log.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        done = np.abs(new - member).max() < 1e-6
        member = new
        if done:
            break
    # a class whose texts get less than half a bad vote on average holds good texts, however it began
    good = rates[:, :, BAD].sum(axis=1) < 0.5
    return member[:, good].sum(axis=1), float(share[good].sum()), rates


class Labels:
    """Posterior of every pattern that the corpus has (bounded by the number of patterns)."""

    def __init__(self, pattern: np.ndarray, n: np.ndarray):
        good, self.prior, self.rates = weigh(pattern, n) if len(n) else (np.empty(0), 0.5, np.zeros((1 + N_VOTERS, N_VOTERS, 3)))
        self.good = np.full(3**N_VOTERS, self.prior)
        self.good[pattern] = good

    def of(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, j in slices(texts):
            out[i:j] = self.good[votes(texts.slice(i, j - i)) @ _POWERS]
        return out


def label_model(docs: DataFrame, text: str = "text") -> Labels:
    t = docs.select(F.col(text).cast("string").alias("text"))
    got = t.mapInArrow(arrow_stage(_patterns), "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
    return Labels(got["pattern"].to_numpy().astype(np.int64), got["n"].to_numpy().astype(np.float64))


def features(texts: pa.Array):
    """(bucket, weight) of each text: roots of the shares of its hashed byte trigrams."""
    raw, off = buffers(texts)
    x = raw.astype(np.uint64)
    tri = (x[:-2] << np.uint64(16)) | (x[1:-1] << np.uint64(8)) | x[2:] if len(x) > 2 else np.empty(0, np.uint64)
    bucket = (mix64(tri + np.uint64(1)) >> np.uint64(50)).astype(np.int64)  # 14 bits
    for k in range(len(off) - 1):
        a, e = off[k], max(off[k], off[k + 1] - 2)
        n = np.bincount(bucket[a:e], minlength=BUCKETS)
        some = np.flatnonzero(n)
        yield some, np.sqrt(n[some] / max(e - a, 1))


def train(docs: DataFrame, labels: Labels, doc_id: str = "doc_id", text: str = "text", taught: int = TAUGHT, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept of the scorer, by adaptive steps (Adam) on the whole sample's logistic loss."""
    spark = docs.sparkSession
    t = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = t.count()
    if n > taught:
        t = t.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < int((1 << 31) * taught / n))
    model = spark.sparkContext.broadcast(labels)
    schema = pa.schema([("y", pa.float64()), ("k", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))])

    def lesson(b):
        for i, j in slices(b.column(1)):
            texts = b.column(1).slice(i, j - i)
            rows = list(features(texts))
            yield batch(schema, model.value.of(texts), [r[0] for r in rows], [r[1].astype(np.float32) for r in rows])

    sample = stored(t.mapInArrow(arrow_stage(lesson), "y double, k array<int>, x array<float>"), "lessons")
    w = np.zeros(BUCKETS + 1)  # the last one is the intercept
    mean, square = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, steps + 1):
        sent = spark.sparkContext.broadcast(w)

        def slope(batches):
            at = sent.value
            g, n = np.zeros(BUCKETS + 1), 0
            for t in batches:
                size = np.diff(t.column(1).offsets.to_numpy())
                k, x = t.column(1).flatten().to_numpy(), t.column(2).flatten().to_numpy()
                row = np.repeat(np.arange(len(size)), size)
                z = np.bincount(row, weights=x * at[k], minlength=len(size)) + at[-1]
                d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - t.column(0).to_numpy()
                g[:-1] += np.bincount(k, weights=x * d[row], minlength=BUCKETS)
                g[-1] += d.sum()
                n += len(d)
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["g", "n"])

        # one sum per task of a sample of bounded size
        got = sample.mapInArrow(slope, "g binary, n long").collect()
        g = sum((np.frombuffer(r["g"]) for r in got), np.zeros(BUCKETS + 1)) / max(sum(r["n"] for r in got), 1)
        g[:-1] += RIDGE * w[:-1]
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w = w - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", taught: int = TAUGHT, steps: int = STEPS) -> DataFrame:
    """``doc_id, posterior, score, kept`` of every row; kept: score of 0.5 or more."""
    spark = docs.sparkSession
    labels = label_model(docs, text)
    w, b = train(docs, labels, doc_id, text, taught, steps)
    model = spark.sparkContext.broadcast((labels, w, b))
    schema = pa.schema([("doc_id", pa.int64()), ("posterior", pa.float64()), ("score", pa.float64()), ("kept", pa.bool_())])

    def scored(x):
        labels, w, b = model.value
        for i, j in slices(x.column(1)):
            texts = x.column(1).slice(i, j - i)
            s = 1 / (1 + np.exp(-np.array([(v * w[k]).sum() + b for k, v in features(texts)])))
            yield batch(schema, x.column(0).slice(i, j - i), labels.of(texts), s, s >= 0.5)

    t = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return t.mapInArrow(arrow_stage(scored), "doc_id long, posterior double, score double, kept boolean")
