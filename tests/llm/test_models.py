"""Learnt operators on the given tables (held-out accuracy) and on odd rows."""

from collections import Counter

import numpy as np

from tests.llm.common import odd_documents, rng
from tokenmill.llm import quality, toxicity
from tokenmill.llm.queries import op6_quality, op9_toxicity

SF = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    got = op9_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.toxic for r in got])
    found = np.mean([r.predicted for r in got if r.toxic])
    assert len(got) > 700 and right > 0.97 and found > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_quality_against_labels_it_never_sees(spark):
    got = op6_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.98
    assert np.mean([not r.kept for r in got if r.quality == 0]) > 0.75


def test_toxicity_odd_rows(spark):
    docs = odd_documents(spark, ["idiot " * 3 + "word", "fine word here"] * 30, [(5, "idiot", "", "", 0), (None, "fine", "", "", 0)])
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 65
    by = {r.doc_id: r.score for r in got}
    assert by[0] > 0.5 > by[1] and by[1000] == by[1001] == by[1002] < 0.5
    assert toxicity.remove(docs, labels).columns == docs.columns
    none = toxicity.score(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_toxicity_words_do_not_share_counts(spark):
    """More words than 2^18: ordinary words seen in a toxic word's place stay ordinary, and the toxic one stays toxic."""
    n, a = 300_000, 1000
    texts = [" ".join(f"w{k}" for k in range(i * a, (i + 1) * a)) for i in range(n // a)]
    bad = [f"zorp{i} slur zorq{i}" for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(len(texts))] + [(len(texts) + i, 1) for i in range(100)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert all(r.predicted == (i >= len(texts)) for i, r in got.items())
    assert len({got[i].score for i in range(len(texts))}) == 1  # none has evidence


def test_toxicity_of_ordinary_words_together(spark):
    """Words that are as common in ordinary texts make a toxic expression."""
    r = rng(5)
    fill = lambda: " ".join(f"v{r.randrange(300)}" for _ in range(8))
    kinds = ["{} go {} home {}", "{} home {} go {}", "{} go home {}"]
    texts = [kinds[i % 3].format(fill(), fill(), fill()) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 2)) for i in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert all(r.predicted == (i % 3 == 2) for i, r in got.items())
    kept = toxicity.remove(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(300) if i % 3 != 2]


def _plain_difference(texts, toxic, taught):
    """Both mean log-likelihoods of every text, word by word, from plain counts; their difference."""
    pairs = [list(zip([""] + t.split()[:-1], t.split())) for t in texts]
    count = {s: Counter(p for i in taught if toxic[i] == s for p in set(pairs[i])) for s in (1, 0)}
    words = {s: Counter(w for _, w in count[s]) for s in (1, 0)}
    shared = Counter(w for _, w in {p for ps in pairs for p in ps})
    total = sum(shared.values()) + toxicity.UNSEEN

    def kept(table, s, discount):
        size = sum(table[s].values()) / sum(table[1 - s].values())
        return {k: max(n - discount * max(1, size) - toxicity.FACTOR * size * table[1 - s][k], 0) for k, n in table[s].items()}

    mean = []
    for s in (1, 0):
        low, high, after, rest = kept(words, s, toxicity.DISCOUNT), kept(count, s, toxicity.PAIR_DISCOUNT), Counter(), Counter()
        n = sum(words[s].values())
        for (h, w), c in count[s].items():
            after[h] += c
            rest[h] += high[h, w]
        lower = lambda w: low.get(w, 0) / n + (1 - sum(low.values()) / n) * shared[w] / total  # noqa: B023, E731
        p = lambda h, w: high.get((h, w), 0) / after[h] + (1 - rest[h] / after[h]) * lower(w) if after[h] else lower(w)  # noqa: B023, E731
        mean.append([np.mean([np.log(p(*x)) for x in ps]) for ps in pairs])
    return np.subtract(*mean)


def test_toxicity_compares_both_mean_log_likelihoods(spark):
    """Words and pairs of both classes, also what speaks for the ordinary one."""
    import zlib

    r = rng(11)
    fill = lambda n: " ".join(f"v{min(r.randrange(60), r.randrange(60))}" for _ in range(n))
    kinds = ["{} thanks a lot {} kind {}", "{} go {} home {} dear {}", "{} go home {} awful {}", "{} {} {}"]
    texts = [kinds[i % 4].format(*(fill(r.randrange(1, 9)) for _ in range(4))) for i in range(400)]
    toxic = [int(i % 4 == 2) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    m = toxicity.fit(docs, labels)
    got = {x.doc_id: x.x for x in docs.select("doc_id", *toxicity._text_keys("text")).join(m.evidence, ["t1", "t2"], "left").collect()}
    taught = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    want = _plain_difference(texts, toxic, taught)
    assert max(abs((m.base if got[i] is None else got[i]) - want[i]) for i in got) < 1e-3
    assert min(want) < m.base < max(want)  # what ordinary texts say counts against


def test_number_of_pairs_is_estimated():
    r = np.random.default_rng(3)
    for n in (100, 50_000, 1_000_000):
        key = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, n, dtype=np.uint64)
        rest = key >> np.uint64(toxicity.REGISTERS)
        rank = 64 - toxicity.REGISTERS + 1 - np.array([int(x).bit_length() for x in rest])
        register = np.zeros(1 << toxicity.REGISTERS, np.int64)
        np.maximum.at(register, (key & np.uint64((1 << toxicity.REGISTERS) - 1)).astype(np.int64), rank)
        assert abs(toxicity.estimate(register) / n - 1) < 0.04


def test_toxicity_folds(spark):
    import zlib

    got = toxicity.score(odd_documents(spark, ["a"] * 50), spark.createDataFrame([(0, 1)], "doc_id long, toxic int")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_label_model_finds_kinds_of_faults():
    good = np.full((1, quality.N_VOTERS), quality.GOOD)
    a, b = good.copy(), good.copy()
    a[0, 0], b[0, 4] = quality.BAD, quality.BAD
    pattern = (np.vstack((good, a, b)) @ quality._POWERS).astype(np.int64)
    post, prior, _ = quality.weigh(pattern, np.array([900.0, 60.0, 40.0]))
    assert post[0] > 0.9 and post[1] < 0.5 and post[2] < 0.5 and 0.85 < prior < 0.95


def test_quality_odd_rows(spark):
    docs = odd_documents(spark, ["A plain line of some words.", "### $$$ %%% ### &&&"] * 20, [(None, "x", "", "", 0)])
    got = {r.doc_id: r for r in quality.score(docs, steps=8).collect()}
    assert len(got) == 44 and got[0].posterior > 0.5 > got[1].posterior and got[1000].posterior == got[1001].posterior
    assert quality.score(docs.limit(0), steps=2).count() == 0
