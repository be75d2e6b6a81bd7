"""As-of passes, crop mode and exact splits against plain versions."""

import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from tokenmill.operators.crop import crop_assignment
from tokenmill.operators.shards import validation_split
from tokenmill.plans.numbering import nearest


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("parts", [1, 9])
def test_nearest(spark, forward, parts):
    r = random.Random(parts)
    points = [r.randrange(1000) for _ in range(60)]
    queries = [(i, r.randrange(-50, 1100)) for i in range(300)]
    q = spark.createDataFrame(queries, "id int, at long")
    p = spark.createDataFrame([(x,) for x in points + points[:5]], "value long")
    got = {x.id: x.near for x in nearest(q, "at", p, "value", "near", forward, parts).collect()}
    points.sort()
    for i, at in queries:
        k = bisect_left(points, at) if forward else bisect_right(points, at) - 1
        assert got[i] == (points[k] if 0 <= k < len(points) else None)


def _cropped(counts, capacity):
    out, file_no, used = {}, 0, 0
    for d, n in sorted(counts.items()):
        if not n:
            continue
        kept = min(n, capacity - used)
        out[d] = (n, kept, file_no)
        used += n
        if used >= capacity:
            file_no, used = file_no + 1, 0
    return out


@pytest.mark.parametrize("capacity", [1, 10, 37, 10_000])
def test_crop_mode(spark, capacity):
    r = random.Random(capacity)
    counts = {d: r.choice([0, 1, 3, 10, 25]) for d in range(200)}
    df = spark.createDataFrame(list(counts.items()), "doc_id long, n long")
    got = {x.doc_id: (x.n, x.kept, x.file_no) for x in crop_assignment(df, capacity).collect()}
    assert got == _cropped(counts, capacity)


def test_crop_mode_without_rows(spark):
    assert crop_assignment(spark.createDataFrame([(1, 0)], "doc_id long, n long"), 5).count() == 0


@pytest.mark.parametrize("n", [1, 7, 499, 500, 501, 900])
def test_exactly_n_rows(spark, n):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3).alias("x"))
    got = validation_split(df, ["k"], n=n).where("is_validation")
    assert got.count() == min(n, 500)
    # a larger split holds a smaller one
    assert got.join(validation_split(df, ["k"], n=n + 50).where("is_validation"), "k", "left_anti").count() == 0
