"""Vocabulary operators: word counts, alphabet, pair counts, merge training, lookup.

The vocabulary is a DataFrame ``token STRING, id INT, kind STRING`` with kinds
``special``, ``char`` (alphabet and ``##`` continuation characters), ``word``
and ``merge``. It is bounded by 16-bit ids (checked), so it may be collected
and broadcast; the corpus and the word-count table never leave the executors.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions import text as tx

# Special tokens, in id order 0..3.
SPECIAL_TOKENS = ["[CLS]", "[SEP]", "[MASK]", "[UNK]"]
CONTINUATION = "##"
MAX_VOCAB_ROWS = 65535
_COUNTED = 100_000  # pieces of text a task counts before it hands their words on

VOCAB_SCHEMA = T.StructType(
    [
        T.StructField("token", T.StringType(), False),
        T.StructField("id", T.IntegerType(), False),
        T.StructField("kind", T.StringType(), False),
    ]
)


def corpus_words(docs: DataFrame, text_col: str = "text", fix=None) -> DataFrame:
    """Normalised, pre-tokenised words of every line: ``doc_id, line_no, word``.

    Lines are split first (1:N) so each Python batch carries lines, not whole books.
    ``fix`` is an optional ``Column -> Column`` repair hook applied before the split.
    """
    text = F.col(text_col) if fix is None else fix(F.col(text_col))
    lines = docs.select("doc_id", F.posexplode(tx.split_lines(text)).alias("line_no", "line"))
    return lines.select(
        "doc_id", "line_no", F.explode(tx.pretokenize(tx.normalize(F.col("line")))).alias("word")
    )


def word_counts(docs: DataFrame, text_col: str = "text", fix=None) -> DataFrame:
    """``word, count`` over the corpus: counted inside each task, then added up by word."""
    text = F.col(text_col) if fix is None else fix(F.col(text_col))
    return docs.select(text.alias("text")).mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("count"))


def _count_words(batches):
    """``word, n`` of a task's texts: what stands between blanks is counted first and split into words once."""
    import pyarrow as pa

    def flush(seen: dict[str, int]):
        words: dict[str, int] = {}
        for piece, n in seen.items():
            for w in tx.words_of(piece):
                words[w] = words.get(w, 0) + n
        return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])

    seen: Counter = Counter()
    for b in batches:
        for text in b.column(0):
            if text.is_valid:
                seen.update(tx.pieces(text.as_py()))
            if len(seen) >= _COUNTED:
                yield flush(seen)
                seen.clear()
    if seen:
        yield flush(seen)


def _chars(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit("(?s)."), 0)


def alphabet(counts: DataFrame, size: int = 100) -> DataFrame:
    """The ``size`` most frequent characters, weighted by word count: ``char, count``.

    Ties are broken by the character (ascending), so the result is deterministic.
    """
    chars = counts.select(F.explode(_chars(F.col("word"))).alias("char"), "count")
    totals = chars.groupBy("char").agg(F.sum("count").alias("count"))
    return totals.orderBy(F.desc("count"), F.asc("char")).limit(size)


def base_vocabulary(alpha: DataFrame) -> DataFrame:
    """Specials (0..3), then alphabet characters and their ``##`` forms in code-point order."""
    spark = alpha.sparkSession
    specials = spark.createDataFrame(
        [(t, i, "special") for i, t in enumerate(SPECIAL_TOKENS)], VOCAB_SCHEMA
    )
    n_special = len(SPECIAL_TOKENS)
    # The alphabet is bounded (<= size rows); ordering it in one task is fine.
    chars = alpha.select("char").withColumn(
        "rank", F.row_number().over(_global_window(F.col("char"))) - 1
    )
    n_chars = F.count(F.lit(1)).over(_global_window())
    plain = chars.select(
        F.col("char").alias("token"), (F.col("rank") + n_special).cast("int").alias("id"), F.lit("char").alias("kind")
    )
    cont = chars.select(
        F.concat(F.lit(CONTINUATION), "char").alias("token"),
        (F.col("rank") + n_special + n_chars).cast("int").alias("id"),
        F.lit("char").alias("kind"),
    )
    return specials.unionByName(plain).unionByName(cont)


def _global_window(*orders):
    """Window over a small, bounded frame (alphabet, top-k words) in one task."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0))
    return w.orderBy(*orders) if orders else w


def word_vocabulary(counts: DataFrame, size: int, min_count: int = 2, alphabet_size: int = 100, alpha: DataFrame | None = None) -> DataFrame:
    """A words-plus-characters vocabulary: base vocabulary, then the most frequent whole words.

    Words must be longer than one character, consist of alphabet characters only
    and occur at least ``min_count`` times; ranked by count desc, word asc.
    ``counts`` is read several times: pass a persisted frame.
    """
    alpha = alpha if alpha is not None else alphabet(counts, alphabet_size)
    base = base_vocabulary(alpha)
    n_base = base.agg(F.count(F.lit(1))).scalar()
    allowed = alpha.agg(F.collect_set("char")).scalar()  # bounded by alphabet_size
    words = counts.filter((F.col("count") >= min_count) & (F.char_length("word") > 1)).filter(
        F.size(F.array_except(_chars(F.col("word")), allowed)) == 0
    )
    ranked = words.orderBy(F.desc("count"), F.asc("word")).limit(max(size, 0))
    ranked = ranked.withColumn("id", F.row_number().over(_global_window(F.desc("count"), F.asc("word"))) - 1 + n_base)
    word_rows = ranked.filter(F.col("id") < size).select(
        F.col("word").alias("token"), F.col("id").cast("int").alias("id"), F.lit("word").alias("kind")
    )
    return base.unionByName(word_rows)


def pair_counts(words: DataFrame, min_frequency: int = 0) -> DataFrame:
    """Adjacent symbol pairs weighted by word count: ``left, right, count``.

    ``words`` has ``symbols ARRAY<STRING>`` and ``count``.
    """
    n = F.size("symbols")
    pairs = words.filter(n > 1).select(
        F.explode(F.arrays_zip(F.slice("symbols", 1, n - 1).alias("left"), F.slice("symbols", 2, n - 1).alias("right"))).alias("p"),
        "count",
    )
    agg = pairs.groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(
        F.sum("count").alias("count")
    )
    return agg.filter(F.col("count") >= min_frequency)


def word_symbols(counts: DataFrame, alpha: DataFrame) -> DataFrame:
    """Split words into alphabet symbols: first character plain, later ones ``##``-prefixed.

    Characters outside the alphabet are dropped from the word.
    """
    allowed = alpha.agg(F.collect_set("char")).scalar()  # bounded by the alphabet size
    chars = counts.withColumn("__allowed", allowed).select(
        "word", "count", F.filter(_chars(F.col("word")), lambda ch: F.array_contains(F.col("__allowed"), ch)).alias("cs")
    )
    symbols = F.transform("cs", lambda ch, i: F.when(i == 0, ch).otherwise(F.concat(F.lit(CONTINUATION), ch)))
    return chars.select("word", "count", symbols.alias("symbols")).filter(F.size("symbols") > 0)


def merge_token(left: str, right: str) -> str:
    return left + (right[len(CONTINUATION):] if right.startswith(CONTINUATION) else right)


def select_round(
    ranked: list[tuple[str, str, int]], known: set[str], room: int, complete: bool = True, by_side: bool = False
) -> list[tuple[str, str, int]]:
    """Merges of one round: the longest prefix of the ranked pairs that equals one-by-one merging.

    ``ranked`` is sorted by count desc, left asc, right asc. A pair is taken while
    its symbols are unused in the round; at the first clash the round stops and
    accepted pairs with the clashing count are dropped (the first one stays).
    The round also ends after a pair (x, x) or one whose merged token already
    exists, and when ``room`` new tokens have been added. When ``ranked`` is
    only the head of a longer list (``complete=False``), unseen pairs may tie
    with its last count, so accepted pairs with that count are dropped too.

    ``by_side=True`` lets pairs share a symbol on the same side: (a, b) and (a, d), or (a, b)
    and (c, b), never overlap in a word, so neither changes the other's count. A new pair
    (x, ab) has at most the count that (x, a) had, which is ranked before it or clashes: only
    a symbol that ends one pair and begins another is a clash.
    """
    taken: list[tuple[str, str, int]] = []
    firsts: set[str] = set()  # symbols that a later pair may not end with
    lasts: set[str] = set()  # symbols that a later pair may not begin with
    made: set[str] = set()
    new_tokens = 0
    ended = None  # the count at which the round ended; a clash behind it at that count still drops pairs
    for left, right, count in ranked:
        if ended is not None and count != ended:
            return taken
        if left in lasts or right in firsts:
            kept = [p for p in taken if p[2] != count]
            return kept if kept else taken[:1]
        if ended is not None:
            continue
        token = merge_token(left, right)
        taken.append((left, right, count))
        firsts.update((left,) if by_side else (left, right))
        lasts.update((right,) if by_side else (left, right))
        exists = token in known or token in made
        if not exists:
            made.add(token)
            new_tokens += 1
        if left == right or exists or new_tokens >= room:
            ended = count
    if not complete and taken:
        kept = [p for p in taken if p[2] != ranked[-1][2]]
        return kept if kept else taken[:1]
    return taken


@dataclass
class TrainResult:
    vocabulary: DataFrame
    merges: list[tuple[str, str, str]]
    rounds: int


# ---- merge training: words are lists of symbol numbers (places in the list of all tokens)

_BLOCK = 65_536  # words a task looks at side by side
_HEAD = 65_536  # pairs at most whose counts the driver knows in a round
_PIECES = 200_000  # distinct pieces of words at most, and
_SYMBOLS = 1_000_000  # symbols in them, that the driver merges in a round
_NONE = np.iinfo(np.int64).max
_WORDS = pa.schema([("ids", pa.list_(pa.int32())), ("n", pa.int64())])


def _blocks(batches):
    """``ids, sizes, n`` of many words at once: all their symbols, how many each has, their weights."""
    held, rows = [], 0

    def joined():
        ids = pa.concat_arrays([b.column(0).flatten() for b in held]).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.concatenate([b.column(0).value_lengths().to_numpy(zero_copy_only=False) for b in held]).astype(np.int64)
        return ids, sizes, np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in held])

    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= _BLOCK:
            yield joined()
            held, rows = [], 0
    if held:
        yield joined()


def _as_words(ids: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))), pa.array(n, pa.int64())], schema=_WORDS)


def _codes(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each symbol with the one behind it as one number; -1 for a word's last symbol."""
    code = np.full(len(ids), -1, np.int64)
    code[:-1] = (ids[:-1] << 32) | ids[1:]
    code[np.cumsum(sizes) - 1] = -1
    return code


def _pair_codes(pairs) -> np.ndarray:
    left, right = np.array(list(pairs), np.int64).reshape(-1, 2).T
    return (left << 32) | right


def _numbered(tokens: list[str]):
    """``symbols, count`` as ``ids, n``."""
    table = pa.array(tokens, pa.string())

    def run(batches):
        for b in batches:
            ids = pc.index_in(b.column(0).flatten(), table).to_numpy(zero_copy_only=False)
            yield _as_words(ids, b.column(0).value_lengths().to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False))

    return run


def _pairs_in(tokens: list[str]):
    """``left, right, n`` of the pairs in a task's words."""

    def run(batches):
        table = pa.array(tokens, pa.string())
        for ids, sizes, n in _blocks(batches):
            code, weight = _codes(ids, sizes), np.repeat(n, sizes)
            code, weight = code[code >= 0], weight[code >= 0]
            if len(code):
                order = np.argsort(code, kind="stable")
                code, first = np.unique(code[order], return_index=True)
                yield pa.RecordBatch.from_arrays([table.take(pa.array(code >> 32)), table.take(pa.array(code & 0xFFFFFFFF)), pa.array(np.add.reduceat(weight[order], first))], names=["left", "right", "n"])

    return run


def _pieces_of(kept: np.ndarray):
    """``piece, n``: what is left of a task's words if they are cut between all neighbours that are no kept pair, as bytes of 32-bit numbers."""

    def run(batches):
        found: dict[bytes, int] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["piece", "n"])
            found.clear()
            return out

        for ids, sizes, n in _blocks(batches):
            joined = np.isin(_codes(ids, sizes), kept)
            ends = joined.copy()
            ends[1:] = joined[:-1] & ~joined[1:]
            ends[0] = False
            starts = joined.copy()
            starts[1:] &= ~joined[:-1]
            starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
            raw, weight = ids.astype(np.int32).tobytes(), np.repeat(n, sizes)[starts].tolist()
            for s, e, w in zip((4 * starts).tolist(), (4 * ends).tolist(), weight):
                piece = raw[s:e]
                found[piece] = found.get(piece, 0) + w
            if len(found) >= _COUNTED:
                yield flush()
        if found:
            yield flush()

    return run


def _merged(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, ranks: np.ndarray, made: np.ndarray):
    """Words after merges, one after the other: ``codes`` are the pairs in order, ``ranks`` their places, ``made`` the token by place.

    In each pass every word takes the first merge behind its last one that it holds; words without one are
    given out, in any order: ``ids, sizes, at``, ``at`` their numbers.
    """
    at, last = np.arange(len(sizes)), np.full(len(sizes), -1, np.int64)
    while len(at):
        code = _codes(ids, sizes)
        k = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        rank = np.where(codes[k] == code, ranks[k], _NONE)
        rank[rank <= np.repeat(last, sizes)] = _NONE
        best = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
        more = best < _NONE
        each = np.repeat(more, sizes)
        yield ids[~each], sizes[~more], at[~more]
        ids, rank, sizes, at, best = ids[each], rank[each], sizes[more], at[more], best[more]
        # left to right without overlap: of x x x the first two
        hit = np.flatnonzero(rank == np.repeat(best, sizes))
        run = np.arange(len(hit))
        start = np.ones(len(hit), bool)
        start[1:] = hit[1:] != hit[:-1] + 1
        hit = hit[(run - np.maximum.accumulate(np.where(start, run, 0))) % 2 == 0]
        ids[hit] = made[rank[hit]]
        word = np.repeat(np.arange(len(sizes)), sizes)
        sizes = sizes - np.bincount(word[hit + 1], minlength=len(sizes))
        ids = np.delete(ids, hit + 1)
        last = best


def _merge_words(merges: list[tuple[int, int, int]]):
    """Words after a round of merges; a word of one symbol has no pairs and is left out."""
    codes = _pair_codes((left, right) for left, right, _ in merges)
    ranks = np.argsort(codes)
    codes, made = codes[ranks], np.array([token for *_, token in merges], np.int64)

    def run(batches):
        for ids, sizes, n in _blocks(batches):
            for i, s, at in _merged(ids, sizes, codes, ranks, made):
                some = s > 1
                if some.any():
                    yield _as_words(i[np.repeat(some, s)], s[some], n[at[some]])

    return run


def _merges_of_pieces(
    pieces: list[tuple[list[str], int]], counts: dict[tuple[str, str], int], kept: set[tuple[str, str]], beyond: int, unknown: int, known: set[str], room: int, min_frequency: int
) -> list[tuple[str, str, str]]:
    """The next merges, as far as the pieces of words tell them for certain; the first one they always do.

    Words were cut between neighbours that are no ``kept`` pair; each of those pairs occurs ``beyond``
    times at most (``counts`` of pairs the driver knows, ``unknown`` at most of any other). A merge moves the ends of tokens
    and not the places where tokens meet, so a pair of tokens that were each made in one way meets where one certain
    pair of symbols did: all of its places are in the pieces, or none is and it occurs no oftener than that pair.
    Where a token was made in two ways (``lasts``, ``firsts``: the symbols its makings end and begin with), pairs may be
    seen in part. They are ranked by the most they can have, and the round ends when one comes first.
    """
    seen: Counter = Counter()
    where: dict[tuple[str, str], set[int]] = {}
    for i, (symbols, n) in enumerate(pieces):
        for p in zip(symbols, symbols[1:]):
            seen[p] += n
            where.setdefault(p, set()).add(i)
    words = [symbols for symbols, _ in pieces]
    before = set(known)
    known, lasts, firsts = set(known), {}, {}
    ways = 1  # of pairs of symbols that one pair of tokens may stand for

    def unseen(p) -> int:
        a, b = lasts.get(p[0], (p[0],)), firsts.get(p[1], (p[1],))
        return 0 if len(a) * len(b) == 1 else sum(counts.get((x, y), unknown) for x in a for y in b if (x, y) not in kept)

    heap = [(-n, *p) for p, n in seen.items()]
    heapq.heapify(heap)
    merges: list[tuple[str, str, str]] = []
    done: set[tuple[str, str]] = set()
    while room > 0:
        least = max(ways * beyond, min_frequency - 1, 0)
        ranked, have, complete, doubt = [], set(), True, False
        while heap:
            n, *p = heap[0]
            p = tuple(p)
            n = -n
            if n <= least:
                break
            if len(ranked) == _AHEAD:
                complete = False
                break
            heapq.heappop(heap)
            hidden = unseen(p)
            if seen[p] + hidden != n or p in have:
                continue  # an entry that was overtaken
            if hidden or p in done:
                complete, doubt = False, True
                break
            have.add(p)
            ranked.append((*p, n))
        taken = select_round(ranked, known, room, complete, by_side=True)
        for left, right, n in ranked[len(taken) :]:
            heapq.heappush(heap, (-n, left, right))
        changed, again = set(), set()
        for left, right, _ in taken:
            token = merge_token(left, right)
            if token not in known:
                known.add(token)
                room -= 1
            elif token not in lasts:
                again.add(token)
            own = {token} if token in before else set()
            for ends, side in ((lasts, right), (firsts, left)):
                had = ends.get(token, own)
                ends[token] = had | ends.get(side, {side})
                if had and ends[token] != had:
                    again.add(token)
            merges.append((left, right, token))
            done.add((left, right))
            for i in where.pop((left, right), ()):
                old, n = words[i], pieces[i][1]
                new, k, end = [], 0, len(old) - 1
                while k <= end:
                    if old[k] == left and k < end and old[k + 1] == right:
                        new.append(token)
                        k += 2
                    else:
                        new.append(old[k])
                        k += 1
                if len(new) == len(old):
                    continue
                for p in zip(old, old[1:]):
                    seen[p] -= n
                    changed.add(p)
                for p in zip(new, new[1:]):
                    seen[p] += n
                    changed.add(p)
                    where.setdefault(p, set()).add(i)
                words[i] = new
        if again:
            ways = max(map(len, lasts.values())) * max(map(len, firsts.values()))
            changed.update(p for p in seen if p[0] in again or p[1] in again)
        for p in changed:
            if seen[p] > 0:
                heapq.heappush(heap, (-seen[p] - unseen(p), *p))
        if doubt or not taken:
            break
    if not merges:  # the head of the ranking itself: all pairs before it are kept and seen whole
        (left, right), n = min(seen.items(), key=lambda x: (-x[1], x[0]))
        merges.append((left, right, merge_token(left, right)))
    return merges


_AHEAD = 64  # pairs looked at for merges that do not touch each other


def train_vocabulary(
    counts: DataFrame,
    vocab_size: int,
    min_frequency: int = 2,
    alphabet_size: int = 100,
    candidates_per_round: int = 1024,
) -> TrainResult:
    """Merge training on the word-count table, many merges per round.

    Same result as merging one best pair at a time (rank: count desc, left asc,
    right asc), stopping at ``vocab_size`` tokens or when the best count falls
    below ``min_frequency``.

    Words are a table in the shared folder. In a round their pairs are counted, and the words are cut between all neighbours that
    are not among the most frequent pairs. Many words leave the same pieces, so few are different: their number is
    bounded, and by it the number of pairs (``candidates_per_round`` in the first round). The driver merges
    inside the pieces as long as they tell the next merge for certain (``_merges_of_pieces``), then one pass over the words
    applies all merges of the round. Words of one symbol leave the table. The bounds change the number of rounds only.
    """
    from tokenmill.session import scratch_path

    spark = counts.sparkSession
    if vocab_size > MAX_VOCAB_ROWS:
        raise ValueError("vocabulary must fit 16-bit ids")

    def written(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    counts = written(counts, "word-counts")  # read twice below: the corpus is counted once
    alpha = spark.createDataFrame(alphabet(counts, alphabet_size).collect(), "char string, count long")  # bounded
    base_rows = base_vocabulary(alpha).collect()
    tokens = [r.token for r in base_rows]
    number = {t: i for i, t in enumerate(tokens)}
    symbols = word_symbols(counts, alpha).where(F.size("symbols") > 1).select("symbols", F.col("count").cast("long").alias("count"))
    words = symbols.mapInArrow(_numbered(tokens), "ids array<int>, n long")
    # as many parts as tasks run at once: every round is one wave over them
    words = written(words.repartition(max(spark.sparkContext.defaultParallelism, words.rdd.getNumPartitions())), "words")
    merges: list[tuple[str, str, str]] = []
    rounds, most = 0, candidates_per_round
    while len(tokens) < vocab_size:
        pairs = words.mapInArrow(_pairs_in(tokens), "left string, right string, n long").groupBy("left", "right").agg(F.sum("n").alias("count"))
        head = pairs.orderBy(F.desc("count"), F.asc("left"), F.asc("right")).limit(_HEAD).toArrow()
        ranked = list(zip(*(head[c].to_pylist() for c in ("left", "right", "count"))))
        enough = sum(n >= max(min_frequency, 1) for *_, n in ranked)
        if not enough:
            break
        unknown = ranked[-1][2] if len(ranked) == _HEAD else 0
        most = min(most, enough)
        while True:
            kept = [(left, right) for left, right, _ in ranked[:most]]
            cut = words.mapInArrow(_pieces_of(_pair_codes((number[left], number[right]) for left, right in kept)), "piece binary, n long")
            found = cut.groupBy("piece").agg(F.sum("n").alias("n")).limit(_PIECES + 1).toArrow()
            size = sum(map(len, found["piece"].to_pylist())) // 4
            if most == 1 or (len(found) <= _PIECES and size <= _SYMBOLS):
                break
            most = max(1, most // 4)
        pieces = [([tokens[i] for i in np.frombuffer(p, np.int32)], n) for p, n in zip(found["piece"].to_pylist(), found["n"].to_pylist())]
        beyond = ranked[most][2] if most < len(ranked) else unknown
        now = _merges_of_pieces(pieces, {(left, right): n for left, right, n in ranked}, set(kept), beyond, unknown, set(tokens), vocab_size - len(tokens), max(min_frequency, 1))
        for *_, token in now:
            if token not in number:
                number[token] = len(tokens)
                tokens.append(token)
        merges += now
        rounds += 1
        words = written(words.mapInArrow(_merge_words([tuple(map(number.get, m)) for m in now]), "ids array<int>, n long"), "words")
        if len(found) <= _PIECES // 4:
            most *= 4
    vocab_rows = [(r.token, r.id, r.kind) for r in base_rows] + [(t, i, "merge") for i, t in enumerate(tokens) if i >= len(base_rows)]
    vocab = spark.createDataFrame(vocab_rows, VOCAB_SCHEMA)
    return TrainResult(vocab, merges, rounds)


def check_vocabulary(vocab: DataFrame) -> DataFrame:
    """One-row report: size, id range, duplicate tokens / ids (must be 0)."""
    return vocab.agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.min("id").alias("min_id"),
        F.max("id").alias("max_id"),
        (F.count(F.lit(1)) - F.countDistinct("token")).alias("dup_tokens"),
        (F.count(F.lit(1)) - F.countDistinct("id")).alias("dup_ids"),
    )


@dataclass(frozen=True)
class Vocab:
    """A collected vocabulary (bounded, checked) with the ids the pipeline needs."""

    tokens: tuple[str, ...]  # index = id

    @staticmethod
    def from_frame(vocab: DataFrame) -> "Vocab":
        rows = vocab.select("token", "id").orderBy("id").limit(MAX_VOCAB_ROWS + 1).collect()
        if len(rows) > MAX_VOCAB_ROWS:
            raise ValueError("vocabulary must fit 16-bit ids")
        ids = [r.id for r in rows]
        if ids != list(range(len(ids))):
            raise ValueError("vocabulary ids must be dense 0..n-1")
        return Vocab(tuple(r.token for r in rows))

    @property
    def size(self) -> int:
        return len(self.tokens)

    def id_of(self, token: str) -> int:
        return self.tokens.index(token)

    @property
    def cls_id(self) -> int:
        return self.id_of("[CLS]")

    @property
    def sep_id(self) -> int:
        return self.id_of("[SEP]")

    @property
    def mask_id(self) -> int:
        return self.id_of("[MASK]")

    @property
    def unk_id(self) -> int:
        return self.id_of("[UNK]")

    @property
    def special_ids(self) -> list[int]:
        return [i for i, t in enumerate(self.tokens) if t in SPECIAL_TOKENS]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        kinds = []
        for t in self.tokens:
            kinds.append("special" if t in SPECIAL_TOKENS else "token")
        return spark.createDataFrame(list(zip(self.tokens, range(self.size), kinds)), VOCAB_SCHEMA)


def lookup_ids(df: DataFrame, vocab: DataFrame, token_col: str = "token", out: str = "id") -> DataFrame:
    """token -> id as a broadcast hash join (vocabulary size is bounded by 16-bit ids)."""
    v = vocab.select(F.col("token").alias("__tok"), F.col("id").alias(out))
    if v.limit(MAX_VOCAB_ROWS + 1).count() > MAX_VOCAB_ROWS:
        raise ValueError("vocabulary must fit 16-bit ids")
    return df.join(F.broadcast(v), df[token_col] == v["__tok"], "left").drop("__tok")
