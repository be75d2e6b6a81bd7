"""Approximate nearest neighbours by a permutation index (largest inner product).

Every vector is represented by its ``prefix`` nearest of ``pivots`` pivots, in order, and
posted with its ranks in the inverted files of these pivots. A query reads the files of
its own nearest pivots and ranks the vectors it meets by footrule distance (a pivot that
one side lacks counts as rank ``prefix``); the best are reranked by exact inner products
of the original vectors.

Inner product becomes distance by one more coordinate that gives all vectors the largest
norm. The index is cut into blocks of bounded size, each with its own inverted files; a
task holds one block and one block of queries. Reranked are ``share`` of each block,
``least`` vectors at least, so recall does not fall as the table grows.

Pivots are a bounded sample (those with the smallest hash of the id); every vector is
indexed. Defined cases: vectors that are null, zero, not of the usual length, or that
hold null or non-finite values take no part, nor do rows without an id; an id that
repeats counts once (its smallest vector); ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 512
PREFIX = 64
SHARE = 0.15
LEAST = 1024
INDEX_BLOCK = 8192
QUERY_BLOCK = 4096

_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, v`` of the rows that take part."""
    t = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    ok = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    t = t.where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
    usual = t.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return t.where(F.size("v") == (usual[0]["n"] if usual else -1))


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending and distinct, and their vectors."""
    ids = t["vec_id"].to_numpy()
    x = t["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    o = np.lexsort((*x.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    ids, x = ids[o], x[o]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], x[first]


def _nearest(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray, k: int) -> np.ndarray:
    """Each vector's ``k`` nearest pivots, nearest first."""
    near = x @ pivots.T + extra[:, None] * pivot_extra
    return np.argsort(-near, axis=1, kind="stable")[:, :k]


def _inverted(order: np.ndarray, n_pivots: int):
    """Inverted files: per pivot, the vectors that list it and at which rank."""
    n, k = order.shape
    pivot = order.ravel()
    o = np.argsort(pivot, kind="stable")
    return (o // k).astype(np.int64), (o % k).astype(np.int32), np.searchsorted(pivot[o], np.arange(n_pivots + 1))


def _search(pivots, top: int, prefix: int, share: float, least: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        if not index.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        p, p_extra, norm2 = pivots.value
        k = min(prefix, len(p))
        (ids, x), (query_ids, q) = _matrix(index), _matrix(queries)
        order = _nearest(x, np.sqrt(np.maximum(norm2 - (x * x).sum(axis=1), 0)), p, p_extra, k)
        vector, rank, file = _inverted(order, len(p))
        asked = _nearest(q, np.zeros(len(q)), p, p_extra, k)
        n = max(least, int(np.ceil(share * len(ids))))
        out = [[], [], []]
        for i, me in enumerate(query_ids):
            # footrule = constant - 2 * (what shared pivots save)
            saved = np.zeros(len(ids), np.int32)
            for r, f in enumerate(asked[i]):
                a, b = file[f], file[f + 1]
                saved[vector[a:b]] += k - np.maximum(rank[a:b], r)
            own = np.searchsorted(ids, me)
            if own < len(ids) and ids[own] == me:
                saved[own] = -1
            some = np.argpartition(-saved, n)[:n] if n < len(ids) else np.arange(len(ids))
            some = some[saved[some] >= 0]
            score = (x[some] * q[i]).sum(axis=1)
            best = np.lexsort((ids[some], -score))[:top]
            out[0].append(np.full(len(best), me))
            out[1].append(ids[some][best])
            out[2].append(score[best])
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=_FOUND)

    return run


def search(vectors: DataFrame, queries: DataFrame, top: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, least: int = LEAST, index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` nearest found of each query, itself left out."""
    spark = vectors.sparkSession
    x, q = usable(vectors, vec_id, embedding), usable(queries, vec_id, embedding)
    chosen = x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).toArrow()
    if not chosen.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    _, p = _matrix(chosen)
    p = np.unique(p, axis=0)
    facts = x.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)).alias("norm2")).collect()[0]
    sent = spark.sparkContext.broadcast((p, np.sqrt(np.maximum(facts["norm2"] - (p * p).sum(axis=1), 0)), facts["norm2"]))
    n_index, n_query = -(-facts["n"] // index_block), max(1, -(-q.count() // query_block))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = x.select("vec_id", "v", block(n_index).alias("i"), every(n_query).alias("j"))
    asks = q.select("vec_id", "v", every(n_index).alias("i"), block(n_query).alias("j"))
    found = rows.groupBy("i", "j").cogroup(asks.groupBy("i", "j")).applyInArrow(_search(sent, top, prefix, share, least), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
