"""Encoding operators: subword encoding, special tokens, truncation, padding, decoding.

Text goes to ids in one Arrow-batched function (normalise, split, greedy longest
match; vocabulary broadcast once, a cache of what stands between blanks kept by each
worker); special tokens, pair layout, truncation, padding and decoding are built-in array functions.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions import text as tx
from tokenmill.operators.vocab import CONTINUATION, Vocab

_WORKER_STATE: dict = {}
_CACHE_LIMIT = 200_000  # words a worker remembers at most; results do not depend on it
_CACHED_CHARS = 64  # longer ones are not remembered, so the cache is bounded in bytes, too
_STATES = 2  # encoders a worker keeps at most, each with its cache


def wordpiece_word(word: str, table: dict, unk: int, max_chars: int, max_piece: int) -> list[int]:
    """Greedy longest-match-first; a word over ``max_chars`` or with an unmatched rest is one unknown id."""
    n = len(word)
    if n > max_chars:
        return [unk]
    out = []
    start = 0
    while start < n:
        end = min(n, start + max_piece)
        found = None
        while start < end:
            piece = word[start:end] if start == 0 else CONTINUATION + word[start:end]
            found = table.get(piece)
            if found is not None:
                break
            end -= 1
        if found is None:
            return [unk]
        out.append(found)
        start = end
    return out


def _longest(pieces) -> re.Pattern:
    """A pattern that matches the longest of the pieces: a trie whose branches differ in their first character."""
    trie: dict = {}
    for p in pieces:
        node = trie
        for ch in p:
            node = node.setdefault(ch, {})
        node[""] = None

    def pattern(node: dict) -> str:
        leaves = [ch for ch, below in node.items() if ch and set(below) == {""}]
        ways = [re.escape(ch) + pattern(below) for ch, below in node.items() if ch and set(below) != {""}]
        if leaves:
            ways.append("[" + "".join(map(re.escape, leaves)) + "]")
        return "(?:" + "|".join(ways) + (")?" if "" in node else ")")

    return re.compile(pattern(trie) if trie else "(?!)")


class _Ids(dict):
    """Ids (as bytes of 32-bit numbers) of whatever stands between two blanks; what was seen is remembered."""

    def __init__(self, tokens, unk: int, max_chars: int, split):
        n = len(CONTINUATION)
        self.firsts = {t: struct.pack("=i", i) for i, t in enumerate(tokens) if t}
        self.rests = {t[n:]: struct.pack("=i", i) for i, t in enumerate(tokens) if t.startswith(CONTINUATION) and len(t) > n}
        self.first, self.rest = _longest(self.firsts).match, _longest(self.rests).findall
        self.unk, self.max_chars, self.split = struct.pack("=i", unk), max_chars, split

    def _word(self, word: str) -> bytes:
        """What ``wordpiece_word`` gives, by one pattern for the first piece and one for the others."""
        if len(word) <= self.max_chars:
            got = self.firsts.get(word)
            if got is not None:
                return got
            head = self.first(word)
            if head:
                rest = self.rest(word, head.end())
                if head.end() + sum(map(len, rest)) == len(word):
                    return self.firsts[head[0]] + b"".join([self.rests[p] for p in rest])
            elif not word:
                return b""
        return self.unk

    def __missing__(self, piece: str) -> bytes:
        got = b"".join(map(self._word, self.split(piece)))
        if len(piece) <= _CACHED_CHARS:
            if len(self) >= _CACHE_LIMIT:
                self.clear()
            self[piece] = got
        return got


def _worker_ids(key: str, bc, unk: int, max_chars: int, split) -> _Ids:
    """The ids of one vocabulary and kind of text, kept by a Python worker from batch to batch and task to task."""
    known = _WORKER_STATE.get(key)
    if known is None:
        if len(_WORKER_STATE) >= _STATES:
            _WORKER_STATE.clear()
        known = _WORKER_STATE[key] = _Ids(bc.value, unk, max_chars, split)
    return known


def _lists(rows: list[bytes | None]) -> pa.Array:
    """Arrow lists of 32-bit ids; None is null."""
    sizes = np.fromiter((0 if r is None else len(r) // 4 for r in rows), np.int64, len(rows))
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    ids = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(r for r in rows if r))])
    return pa.ListArray.from_arrays(pa.array(offsets), ids, mask=pa.array([r is None for r in rows], pa.bool_()))


def _make_encoders(vocab: Vocab, bc, max_chars: int):
    """Functions of words, of normalised text and of raw text; each gives the ids in one crossing to Python."""
    unk = vocab.unk_id
    key = hashlib.sha1("\n".join([str(max_chars), *vocab.tokens]).encode()).hexdigest()

    def encoder(kind: str, parts, split):
        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def encode(values: pa.Array) -> pa.Array:
            known = _worker_ids(key + kind, bc, unk, max_chars, split)
            # text by text: a batch of long texts is never held as Python strings
            values = (v.as_py() for v in values)
            return _lists([None if v is None else b"".join(map(known.__getitem__, parts(v))) for v in values])

        return encode

    return (
        encoder("words", lambda words: words, lambda word: [word]),
        encoder("normalized", tx.pieces, tx.split_words),
        encoder("raw", tx.pieces, tx.words_of),
    )


class Encoder:
    """Binds a collected vocabulary (broadcast once) to the encoding operators."""

    def __init__(self, vocab: Vocab, spark, max_chars_per_word: int = 50):
        self.vocab = vocab
        self.max_chars = max_chars_per_word
        self._bc = spark.sparkContext.broadcast(list(vocab.tokens))
        self._words, self._normalized, self._raw = _make_encoders(vocab, self._bc, max_chars_per_word)

    # C4: words -> ids
    def encode_words(self, words) -> Column:
        words = F.col(words) if isinstance(words, str) else words
        return self._words(words)

    # C5: text -> ids without special tokens (normalise, pre-tokenise, subword)
    def encode_plain(self, text, normalized: bool = False) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        return self._normalized(text) if normalized else self._raw(text)

    # C6: [CLS] ids [SEP], optionally truncated to ``max_length`` including specials
    def encode_single(self, ids, max_length: int | None = None) -> Column:
        return encode_single(ids, self.vocab.cls_id, self.vocab.sep_id, max_length)

    # C7 + C8: [CLS] a [SEP] b [SEP] with type ids, longest-first truncation
    def encode_pair(self, ids_a, ids_b, max_length: int | None = None) -> Column:
        return encode_pair(ids_a, ids_b, self.vocab.cls_id, self.vocab.sep_id, max_length)

    def decode(self, ids, skip_special_tokens: bool = True) -> Column:
        return decode(ids, self.vocab, skip_special_tokens)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def encode_single(ids, cls_id: int, sep_id: int, max_length: int | None = None) -> Column:
    ids = _c(ids)
    if max_length is not None:
        ids = F.slice(ids, 1, max_length - 2)
    return F.concat(F.array(F.lit(cls_id)), ids, F.array(F.lit(sep_id)))


def pair_truncation_lengths(len_a: Column, len_b: Column, budget: int) -> tuple[Column, Column]:
    """Longest-first lengths kept of a pair when ``len_a + len_b`` exceeds ``budget``.

    With s the shorter and g the longer length: the shorter keeps all of itself
    and the longer gets the rest (at least as much as the shorter); if that still
    does not fit, the budget is halved, the longer side getting the odd token.
    On equal lengths the first sequence counts as the shorter one.
    """
    swap = len_a > len_b
    s = F.least(len_a, len_b)
    g = F.greatest(len_a, len_b)
    t_s = s
    t_g = F.when(s > budget, s).otherwise(F.greatest(s, F.lit(budget) - s))
    over = (t_s + t_g) > budget
    half = budget // 2
    t_s2 = F.when(over, F.lit(half)).otherwise(t_s)
    t_g2 = F.when(over, F.lit(half + budget % 2)).otherwise(t_g)
    keep_s = F.least(s, t_s2)
    keep_g = F.least(g, t_g2)
    fits = (len_a + len_b) <= budget
    keep_a = F.when(fits, len_a).when(swap, keep_g).otherwise(keep_s)
    keep_b = F.when(fits, len_b).when(swap, keep_s).otherwise(keep_g)
    return keep_a, keep_b


def encode_pair(ids_a, ids_b, cls_id: int, sep_id: int, max_length: int | None = None) -> Column:
    """Struct ``ids, type_ids`` for ``[CLS] a [SEP] b [SEP]`` (type 0 for the first part)."""
    a, b = _c(ids_a), _c(ids_b)
    if max_length is not None:
        ka, kb = pair_truncation_lengths(F.size(a), F.size(b), max_length - 3)
        a = F.slice(a, 1, ka)
        b = F.slice(b, 1, kb)
    ids = F.concat(F.array(F.lit(cls_id)), a, F.array(F.lit(sep_id)), b, F.array(F.lit(sep_id)))
    types = F.concat(F.array_repeat(F.lit(0), F.size(a) + 2), F.array_repeat(F.lit(1), F.size(b) + 1))
    return F.struct(ids.alias("ids"), types.alias("type_ids"))


def pad_to(ids, length, pad_id: int) -> Column:
    """Right-pad an id array with ``pad_id`` up to ``length``."""
    ids = _c(ids)
    length = F.lit(length) if isinstance(length, int) else _c(length)
    return F.concat(ids, F.array_repeat(F.lit(pad_id), F.greatest(length - F.size(ids), F.lit(0))))


def pad_to_longest(df: DataFrame, ids_col: str, pad_id: int, out: str | None = None, extra_zero_cols=()) -> DataFrame:
    """Pad every row to the longest array of the whole frame (a scalar subquery, no join)."""
    out = out or ids_col
    longest = df.agg(F.max(F.size(ids_col))).scalar()
    padded = df.withColumn("__longest", longest)
    padded = padded.withColumn(out, pad_to(ids_col, F.col("__longest"), pad_id))
    for c in extra_zero_cols:
        padded = padded.withColumn(c, pad_to(c, F.col("__longest"), 0))
    return padded.drop("__longest")


# A later token starting with one of these gets no space before it.
NO_SPACE_BEFORE = [".", "?", "!", ",", "n't", "'m", "'s", "'ve", "'re"]


def _decoder(tokens: tuple[str, ...], special_ids):
    """Arrow form of ``decode`` over a broadcast vocabulary: two entries a token, inside a text and at its start."""
    inner = []
    for t in tokens:
        if t.startswith(CONTINUATION):
            inner.append(t[len(CONTINUATION) :])
        else:
            inner.append(t if t.startswith(tuple(NO_SPACE_BEFORE)) else " " + t)
    table = pa.array([*inner, *tokens], pa.large_string())
    n = len(tokens)
    keep = np.ones(n, bool)
    keep[list(special_ids)] = False

    def run(ids):
        lists = ids.cast(pa.large_list(pa.int64()))
        valid = lists.is_valid().to_numpy(zero_copy_only=False)
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        flat = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)
        if (known & ((flat < 0) | (flat >= n))).any():
            raise ValueError("an id is not in the vocabulary")
        some = known & keep[np.where(known, flat, 0)]
        flat, row = flat[some], row[some]
        first = np.ones(len(row), bool)
        first[1:] = row[1:] != row[:-1]
        pieces = table.take(pa.array(flat + n * first))
        ends = np.searchsorted(row, np.arange(len(size) + 1))
        # the pieces of a row lie side by side, so its text is a range of their buffer
        bounds = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, 8 * pieces.offset)[ends]
        text = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds), pieces.buffers()[2]).cast(pa.string())
        return pc.if_else(pa.array(valid), text, pa.scalar(None, pa.string()))

    return run


def decode(ids, vocab: Vocab, skip_special_tokens: bool = True) -> Column:
    """ids -> text: ``##`` pieces glued, other tokens space-separated, no space before . ? ! , and contractions.

    The vocabulary travels as one broadcast and ids are gathered from it in Arrow buffers, so
    the plan has the same size for any vocabulary. An id outside it is an error.
    """
    spark = SparkSession.getActiveSession()
    special = tuple(vocab.special_ids) if skip_special_tokens else ()
    sent = spark.sparkContext.broadcast((vocab.tokens, special))

    @F.arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = _decoder(*sent.value)
        for b in batches:
            yield run(b)

    return text_of(_c(ids))


def highlight_mask(text, mask_token: str = "[MASK]") -> Column:
    return F.replace(_c(text), F.lit(mask_token), F.lit(f"**{mask_token}**"))
