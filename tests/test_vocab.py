"""Vocabulary: alphabet, base ids, batched merge rounds equal one-at-a-time merging."""

from tokenmill.operators import vocab as V

WORDS = [
    ("lower", 12), ("lowest", 7), ("newer", 9), ("wider", 5), ("new", 14), ("low", 11), ("widest", 3),
    ("aaaa", 4), ("banana", 6), ("bandana", 3), ("ananas", 2), ("nana", 5), ("abab", 3), ("baba", 3),
]


def _one_by_one(counts_rows, vocab_size, min_frequency=2, alphabet_size=100):
    """One best merge at a time, in plain Python."""
    from collections import Counter

    char_totals: Counter = Counter()
    for word, c in counts_rows:
        for ch in word:
            char_totals[ch] += c
    alpha = sorted(char_totals.items(), key=lambda kv: (-kv[1], kv[0]))[:alphabet_size]
    allowed = sorted(ch for ch, _ in alpha)
    vocab = list(V.SPECIAL_TOKENS) + allowed + [V.CONTINUATION + ch for ch in allowed]
    known = set(vocab)
    words = []
    for word, c in counts_rows:
        cs = [ch for ch in word if ch in set(allowed)]
        if cs:
            words.append(([cs[0]] + [V.CONTINUATION + ch for ch in cs[1:]], c))
    merges = []
    while len(vocab) < vocab_size:
        pc: Counter = Counter()
        for syms, c in words:
            for a, b in zip(syms, syms[1:]):
                pc[(a, b)] += c
        if not pc:
            break
        (a, b), c = min(pc.items(), key=lambda kv: (-kv[1], kv[0][0], kv[0][1]))
        if c < min_frequency:
            break
        token = V.merge_token(a, b)
        merges.append((a, b, token))
        if token not in known:
            known.add(token)
            vocab.append(token)
        new_words = []
        for syms, cnt in words:
            out, i = [], 0
            while i < len(syms):
                if i + 1 < len(syms) and syms[i] == a and syms[i + 1] == b:
                    out.append(token)
                    i += 2
                else:
                    out.append(syms[i])
                    i += 1
            new_words.append((out, cnt))
        words = new_words
    return vocab, merges



def test_select_round_rules():
    ranked = [("a", "##b", 10), ("c", "##d", 9), ("a", "##x", 8), ("e", "##f", 7)]
    assert V.select_round(ranked, {"a", "##b", "c", "##d", "##x", "e", "##f"}, 100) == ranked[:2]
    tie = [("a", "##b", 10), ("c", "##d", 8), ("a", "##x", 8)]
    assert V.select_round(tie, set(), 100) == tie[:1]
    same = [("##a", "##a", 10), ("c", "##d", 9)]
    assert V.select_round(same, set(), 100) == same[:1]
    assert V.select_round(ranked, set(), 1) == ranked[:1]


def test_batched_training_equals_one_by_one(spark):
    counts = spark.createDataFrame(WORDS, "word string, count long")
    for size in (20, 28, 40):
        res = V.train_vocabulary(counts, vocab_size=size, min_frequency=2, candidates_per_round=4)
        got = [r.token for r in res.vocabulary.orderBy("id").collect()]
        want, merges = _one_by_one(WORDS, size, min_frequency=2)
        assert got == want
        assert [m[2] for m in res.merges] == [m[2] for m in merges]


def test_word_vocabulary_layout(spark):
    docs = spark.createDataFrame([(0, "b a b a c"), (1, "ab ab ab ba")], "doc_id long, text string")
    vocab = V.word_vocabulary(V.word_counts(docs), 100, 2)
    rows = [(r.token, r.id) for r in vocab.orderBy("id").collect()]
    assert rows[:4] == [("[CLS]", 0), ("[SEP]", 1), ("[MASK]", 2), ("[UNK]", 3)]
    assert [t for t, _ in rows[4:7]] == ["a", "b", "c"]
    assert [t for t, _ in rows[7:10]] == ["##a", "##b", "##c"]
    assert [t for t, _ in rows[10:]] == ["ab"]
    rep = V.check_vocabulary(vocab).first()
    assert rep.dup_tokens == 0 and rep.dup_ids == 0


def test_pairs_that_share_a_side_are_merged_in_one_round():
    ranked = [("a", "##b", 10), ("a", "##c", 9), ("d", "##b", 8), ("##b", "##e", 7), ("f", "##g", 6)]
    assert V.select_round(ranked, set(), 100, by_side=True) == ranked[:3]
    assert V.select_round(ranked, set(), 100) == ranked[:1]
    # (x, a) may have become (x, ab): a clash, as is a symbol beside itself
    assert V.select_round([("##a", "##b", 10), ("##x", "##a", 9)], set(), 100, by_side=True) == [("##a", "##b", 10)]
    assert V.select_round([("##a", "##b", 10), ("##a", "##a", 9)], set(), 100, by_side=True) == [("##a", "##b", 10)]


def test_rounds_by_side_equal_one_by_one_on_random_words(spark):
    import random

    r = random.Random(5)
    rows = sorted({"".join(r.choice("abcd") for _ in range(r.randint(1, 7))): r.randint(1, 30) for _ in range(60)}.items())
    res = V.train_vocabulary(spark.createDataFrame(rows, "word string, count long"), vocab_size=45, min_frequency=2)
    want, merges = _one_by_one(rows, 45)
    assert [x.token for x in res.vocabulary.orderBy("id").collect()] == want
    assert res.merges == merges and res.rounds < len(merges)


def test_word_counts_equal_the_words_of_all_lines(spark):
    texts = ["The cat's  café\tCAFÉ\nnaïve 3x4 Å¨ a", "x" * 300 + " İstanbul ﬁne\r\n y\x1cz \x85q", None, "", " \n "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = V.corpus_words(docs).groupBy("word").count()
    assert sorted(map(tuple, V.word_counts(docs).collect())) == sorted(map(tuple, plain.collect()))


def test_a_tie_behind_the_last_pair_of_a_round_counts():
    # ("##z", "##m") becomes ("##az", "##m"), which stands before ("##q", "##q") at the same count
    tie = [("##a", "##z", 3), ("##q", "##q", 3), ("##z", "##m", 3)]
    assert V.select_round(tie, {"##az"}, 100, by_side=True) == tie[:1]
    assert V.select_round(tie[1:], set(), 1, by_side=True) == tie[1:2]


def test_a_round_merges_more_than_pairs_that_do_not_touch(spark):
    """A word grows from its letters to a token in one round, not in one round a letter."""
    rows = [("abcdefgh", 90), ("abcdefgx", 40), ("uvwxyz", 30), ("uvw", 9)]
    res = V.train_vocabulary(spark.createDataFrame(rows, "word string, count long"), vocab_size=100, min_frequency=2)
    want, merges = _one_by_one(rows, 100)
    assert [x.token for x in res.vocabulary.orderBy("id").collect()] == want
    assert res.merges == merges and len(merges) > 10 and res.rounds == 1


def test_rounds_of_few_kept_pairs_equal_one_by_one(spark, monkeypatch):
    """Pieces of words, tokens made in two ways, an alphabet with the sign of a continuation, bounds that bite."""
    import random

    monkeypatch.setattr(V, "_PIECES", 6)
    monkeypatch.setattr(V, "_HEAD", 9)
    for seed, letters in ((1, "ab"), (2, "ab#")):
        r = random.Random(seed)
        rows = sorted({"".join(r.choice(letters) for _ in range(r.randint(1, 9))): r.randint(1, 9) for _ in range(25)}.items())
        res = V.train_vocabulary(spark.createDataFrame(rows, "word string, count long"), vocab_size=26, min_frequency=2, candidates_per_round=3)
        want, merges = _one_by_one(rows, 26)
        assert [x.token for x in res.vocabulary.orderBy("id").collect()] == want
        assert res.merges == merges
