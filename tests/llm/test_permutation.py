"""Permutation index: exact when all is reranked, high recall otherwise, odd vectors left out."""

import numpy as np

from tokenmill.llm import permutation


def _brute(ids, x, queries, top):
    out = {}
    for q in queries:
        s = (x * x[list(ids).index(q)]).sum(axis=1)
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:top]
        out[q] = [ids[i] for i in order]
    return out


def _found(df, queries, **kw):
    out = {}
    for r in sorted(permutation.search(df, queries, **kw).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_recall(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = t.orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=float)
    got = _found(t, t.where("vec_id % 40 = 0"), least=50, index_block=500, query_block=20)
    want = _brute(ids, x, [i for i in ids if i % 40 == 0], 20)
    recall = np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want])
    assert recall >= 0.9
    exact = _found(t, t.where("vec_id % 400 = 0"))
    assert exact == {q: w for q, w in want.items() if q % 400 == 0}


def test_norms_ties_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)) * rng.uniform(0.1, 9, size=(60, 1))
    x[7] = x[3]
    data = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)]
    odd = [(100, None, ""), (101, [], ""), (102, [0.0] * 5, ""), (103, [1.0, None, 1.0, 1.0, 1.0], ""), (104, [float("nan")] * 5, ""), (105, [float("inf")] * 5, ""), (None, [1.0] * 5, ""), (106, [1.0] * 3, ""), (3, data[3][1], "")]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, rank string")
    got = _found(df, df, top=8, index_block=9, query_block=7)
    assert got == _brute(list(range(60)), x, range(60), 8)
    assert permutation.search(df.limit(0), df.limit(0)).count() == 0
