"""Normalise, pre-tokenise, subword-encode and decode: round trips as in the reference tests,
plus equality with the public tokenizers package's normaliser / pre-tokeniser where installed."""

import random

import pytest
from pyspark.sql import functions as F

from tokenmill.functions import text as tx
from tokenmill.operators import vocab as V
from tokenmill.operators.encode import Encoder, pair_truncation_lengths

LONG_WORD = "ab" * 150
WORDS = "many gaps here mixed case stops , and marks ! an odd sign year 1 9 8 4"


def _texts():
    """Random texts of words, case, blanks, digits, signs and characters that the vocabulary lacks."""
    r = random.Random(11)
    vocabulary = [w for w in WORDS.split() if w.isalpha()]
    for _ in range(60):
        parts, want = [], ""
        for _ in range(r.randrange(6)):
            word = r.choice(vocabulary)
            kind = r.randrange(5)
            parts.append({0: word, 1: word.upper(), 2: word + ",", 3: word + "!", 4: r.choice(["龘", LONG_WORD, "19"])}[kind])
            if kind < 4:
                want += (" " if want else "") + word + {2: ",", 3: "!"}.get(kind, "")
            elif parts[-1] == "19":
                want += (" " if want else "") + "1 9"
        yield "".join(r.choice([" ", "  ", "\t", "\n "]) + p for p in parts) + r.choice(["", " "]), want


@pytest.fixture(scope="module")
def encoder(spark):
    # Vocabulary built from a small corpus covering the words (the odd character excluded).
    corpus = [WORDS] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus)], "doc_id long, text string")
    counts = V.word_counts(docs)
    vocab = V.Vocab.from_frame(V.word_vocabulary(counts, 200, 2))
    return Encoder(vocab, spark)


def test_round_trips(spark, encoder):
    cases = list(_texts())
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, text string")
    out = df.select("i", encoder.decode(encoder.encode_plain("text")).alias("back")).orderBy("i").collect()
    assert [r.back for r in out] == [e for _, e in cases]


def test_decode_of_a_large_vocabulary(spark):
    from tokenmill.operators.encode import decode

    tokens = tuple([*V.SPECIAL_TOKENS, *(f"##p{i}" if i % 3 == 0 else f"w{i}" for i in range(65_531))])
    v = V.Vocab(tokens)
    rows = [([4, 65_534, 7], "##p0 w65530p3"), ([0, 5, 1], "w1"), ([], ""), (None, None), ([65_533, 65_533], "##p65529p65529")]
    df = spark.createDataFrame(rows, "ids array<int>, want string")
    plan = df.select("want", decode("ids", v).alias("text"))
    assert {(r.text, r.want) for r in plan.collect()} == {(w, w) for _, w in rows}
    assert len(plan._jdf.queryExecution().toString()) < 20_000


def test_lower_case_by_character(spark):
    df = spark.createDataFrame([("ΟΔΟΣ ΣΑΣ",)], "text string")
    assert df.select(tx.normalize(F.col("text")).alias("t")).first().t == "οδοσ σασ"


def test_decode_refuses_unknown_ids(spark, encoder):
    df = spark.createDataFrame([([encoder.vocab.size],)], "ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        df.select(encoder.decode("ids")).collect()


def test_long_word_is_one_unknown(spark, encoder):
    df = spark.createDataFrame([(LONG_WORD,)], "text string")
    assert df.select(encoder.encode_plain("text").alias("ids")).first().ids == [encoder.vocab.unk_id]


def test_decode_keeps_specials_on_request(spark, encoder):
    v = encoder.vocab
    df = spark.createDataFrame([([v.cls_id, v.id_of("gaps"), v.mask_id, v.sep_id],)], "ids array<int>")
    assert df.select(encoder.decode("ids", skip_special_tokens=False).alias("t")).first().t == "[CLS] gaps [MASK] [SEP]"
    assert df.select(encoder.decode("ids").alias("t")).first().t == "gaps"


def test_paragraph_filter(spark):
    text = "short\r\n\r\nthis paragraph is long enough\n\nalso long enough to be kept\n\ntiny"
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(tx.paragraph_filter("text").alias("t")).first().t == "this paragraph is long enough\nalso long enough to be kept"


SAMPLES = [
    "Héllo, wörld! It's 2024: naïve café — ½ price; ﬁne “quotes” 911?",
    "Tabs\tand\x0bvertical tabs, ＦＵＬＬ width, emoji 😀 and #hash$ +plus=",
    "Ünïcödé ÀÉÎÕÜ ß æ ø å ñ ç",
]


def test_normalize_and_pretokenize_match_public_library(spark):
    pytest.importorskip("tokenizers")
    from tokenizers import normalizers, pre_tokenizers

    norm = normalizers.Sequence([normalizers.NFKD(), normalizers.StripAccents(), normalizers.Lowercase()])
    pre = pre_tokenizers.Sequence(
        [pre_tokenizers.Whitespace(), pre_tokenizers.Punctuation(behavior="isolated"), pre_tokenizers.Digits(individual_digits=True)]
    )
    df = spark.createDataFrame([(s,) for s in SAMPLES], "text string")
    rows = df.select("text", tx.normalize("text").alias("n")).withColumn("w", tx.pretokenize("n")).collect()
    for r in rows:
        expected_norm = norm.normalize_str(r.text)
        assert r.n == expected_norm
        assert r.w == [w for w, _ in pre.pre_tokenize_str(expected_norm)]


def test_ids_like_the_public_library(spark):
    """Encoding with a merge-trained vocabulary (pieces of several characters) against the public package."""
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers.models import WordPiece

    docs = spark.createDataFrame([(i, "lower lowest newer newest wider widest low new wide " * 3) for i in range(4)], "doc_id long, text string")
    vocab = V.Vocab.from_frame(V.train_vocabulary(V.word_counts(docs), vocab_size=60, min_frequency=2).vocabulary)
    assert any(t.startswith("##") and len(t) > 4 for t in vocab.tokens)
    model = tokenizers.Tokenizer(WordPiece({t: i for i, t in enumerate(vocab.tokens)}, unk_token="[UNK]", max_input_chars_per_word=50))
    words = ["lowest", "newest", "wides", "lowerwide", "newq", "w", "estest", "a" * 60]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rows = df.select("w", Encoder(vocab, spark).encode_words(F.array("w")).alias("ids")).collect()
    assert {r.w: r.ids for r in rows} == {w: model.encode(w).ids for w in words}


def test_two_vocabularies_in_one_worker(spark):
    a, b = (V.Vocab(("[CLS]", "[SEP]", "[MASK]", "[UNK]", *more)) for more in (("x", "##y"), ("##y", "x")))
    df = spark.createDataFrame([("xyy",)], "w string").coalesce(1)
    ids = [df.select(Encoder(v, spark).encode_words(F.array("w")).alias("i")).first().i for v in (a, b, a)]
    assert ids == [[4, 5, 5], [5, 4, 4], [4, 5, 5]]


def _expected(a, b, budget):
    """Longest-first: the shorter side (the first on ties) keeps itself if it fits in half the
    budget and the longer takes the rest; otherwise both get half, the longer the odd token."""
    if a + b <= budget:
        return a, b
    first_shorter = a <= b
    s, g = (a, b) if first_shorter else (b, a)
    if s <= budget - s:
        ks, kg = s, min(g, budget - s)
    else:
        ks, kg = budget // 2, budget // 2 + budget % 2
    return (ks, kg) if first_shorter else (kg, ks)


def test_pair_truncation_lengths(spark):
    lengths = list(range(20)) + [60, 63, 64, 125, 130, 200]
    pairs = [(x, y) for x in lengths for y in lengths]
    df = spark.createDataFrame(pairs, "a int, b int")
    for budget in (10, 125):
        ka, kb = pair_truncation_lengths(F.col("a"), F.col("b"), budget)
        for r in df.select("a", "b", ka.alias("ka"), kb.alias("kb")).collect():
            assert (r.ka, r.kb) == _expected(r.a, r.b, budget), (r.a, r.b, budget)


def test_fix_text_order(spark):
    """What decoding produces is repaired, too; damage is undone run by run; losses stay."""
    cases = {
        "&ldquo;hi&rdquo; it&rsquo;s a&#8232;b": '"hi" it\'s a\nb',
        "itâ€™s": "it's",
        "cafÃ© 😀 &amp; naïve": "cafe\u0301 😀 & nai\u0308ve",
        "Ã\x83Â©": "e\u0301",
        "lost \ufffd": "lost \ufffd",
        "&amp;lt; &lt;b&gt;": "&lt; <b>",
        "déjà Ä Ö Â £5": "de\u0301ja\u0300 A\u0308 O\u0308 A\u0302 £5",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    rows = {r.t: r.f for r in df.select("t", tx.fix_text("t").alias("f")).collect()}
    assert rows.pop(None) is None
    assert rows == cases


def test_fix_text_builtin_steps(spark):
    raw = "a\x1b[31mred\x1b[0m\r\nline‘quote’ “dq”\x07bell &amp; ﬁne"
    df = spark.createDataFrame([(raw,)], "t string")
    out = df.select(tx.fix_text("t").alias("f")).first().f
    assert out == "ared\nline'quote' \"dq\"bell & fine"


def test_sequences_that_lost_bytes():
    right = "«naïve» ½ – „Æther“ … 😀 voilà?"
    misread = "".join(bytes([b]).decode("cp1252", "ignore") or "\ufffd" for b in right.encode())
    got = tx.repair_encoding(misread)
    # of the curved quotes and the emoji a byte has no character in the code page
    assert got.replace("\ufffd", "") == "".join(c for c in right if all(bytes([b]).decode("cp1252", "ignore") for b in c.encode()))
    assert tx.repair_encoding("quote â€\ufffd end") == "quote \ufffd end"
    assert tx.repair_encoding("quote â€\x1a end") == "quote \ufffd end"
    assert tx.repair_encoding("space Â? end") == "space \ufffd end"
    assert tx.repair_encoding("dash â?“ end") == "dash \ufffd end"
    assert tx.repair_encoding("smile ðŸ?€ end") == "smile \ufffd end"
    for whole in ("voilà? oui", "déjà vu??", "où est-il? là?", "plain \ufffd stays", "é?? what"):
        assert tx.repair_encoding(whole) == whole


def test_cached_pieces_equal_the_longest_match_of_every_word(spark):
    import random

    import numpy as np

    from tokenmill.functions import text as tx
    from tokenmill.operators import encode as E

    r = random.Random(3)
    tokens = ["[CLS]", "[SEP]", "[MASK]", "[UNK]", "a", "b", "(", "##a", "##b", "##c", "abc", "##bca", "ab", "##]", "####"]
    table = {t: i for i, t in enumerate(tokens)}
    ids = E._Ids(tokens, 3, 6, tx.words_of)
    for _ in range(2000):
        w = "".join(r.choice("abc(]#é") for _ in range(r.randint(0, 8)))
        assert np.frombuffer(ids._word(w), np.int32).tolist() == E.wordpiece_word(w, table, 3, 6, 5), w
        text = " ".join("".join(r.choice("abAB,\n\tÉ") for _ in range(r.randint(0, 6))) for _ in range(4))
        want = [i for x in tx.split_words(tx.normalize_one(text)) for i in E.wordpiece_word(x, table, 3, 6, 5)]
        assert np.frombuffer(b"".join(map(ids.__getitem__, tx.pieces(text))), np.int32).tolist() == want
    ids["x" * 100]
    assert "x" * 100 not in ids
