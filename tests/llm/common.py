"""Small tables with every odd case: nulls, empty and white texts, repeated rows, clashing names."""

import random

WORDS = "the of and to in alpha beta gamma delta über né 中文 x1 A&B ## it's".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_documents(spark, texts, extra=()):
    """Documents 0.. with the texts, columns named like the operators' own, and odd rows."""
    rows = [(i, t, "k", "n", i) for i, t in enumerate(texts)] + [(1000, None, None, None, None), (1001, "", "", "", 0), (1002, " \t\n", "", "", 0), *extra]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, rank string, count long")


def rng(seed):
    return random.Random(seed)
