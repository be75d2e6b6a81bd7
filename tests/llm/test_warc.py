"""Revisit resolution against a plain scan; one URL over many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from tokenmill.llm import warc


def _plain(rows):
    out = {}
    for r in rows:
        rid, canon, at, full, etag, lm, dg = r
        if full:
            continue
        before = [x for x in rows if x[3] and x[1] == canon and (x[2], x[0]) < (at, rid)] if canon is not None else []
        if not before:
            out[rid] = ("no-response", None)
            continue
        s = max(before, key=lambda x: (x[2], x[0]))
        verdict = "unchecked"
        for name, a, b in (("etag", etag and etag.removeprefix("W/"), s[4] and s[4].removeprefix("W/")), ("last-modified", lm, s[5]), ("digest", dg, s[6])):
            if a is not None and b is not None:
                verdict = name if a == b else "mismatch"
                break
        out[rid] = (verdict, s[0] if verdict in ("etag", "last-modified", "digest") else None)
    return out


@pytest.mark.parametrize("parts", ["1", "9"])
def test_like_a_plain_scan(spark, parts):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        url = "a.com/x" if rng.random() < 0.6 else rng.choice(["a.com/y", "b.org", "b.org/z?k=1", None])
        rows.append((i, url, rng.randrange(60), rng.random() < 0.15, rng.choice(["1", "2", "W/1", None]), rng.choice(["m", "n", None]), rng.choice(["d", None])))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.createDataFrame([(i, u and "http://www." + u.upper().replace("X", "x").replace("Y", "y").replace("Z?K", "z?k"), at, full, e, m, d, None) for i, u, at, full, e, m, d in rows], warc.RECORDS)
    got = {r.record_id: (r.verdict, r.source_id) for r in warc.resolve(df).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == _plain(rows)


def test_urls_and_headers(spark):
    urls = {
        "HTTP://WWW.Example.com:80/A/?b=2&utm_source=x&a=1#f": "example.com/A?a=1&b=2",
        "https://example.com:443": "example.com",
        "https://example.com:80/": "example.com:80",
        "example.com/p?": "example.com/p",
        "": "",
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", warc.canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == urls
    rows = [
        (1, "http://a/", 1, True, "e", None, None, {"Content-Type": "text/html", "Date": "1", "content-length": "9"}),
        (2, "http://a", 2, False, 'W/e', None, None, {"date": "2", "DATE": "3", "Content-Length": "0", "Vary": "x"}),
        (3, "http://a", None, False, "e", None, None, None),
    ]
    got = {r.record_id: r for r in warc.resolve(spark.createDataFrame(rows, warc.RECORDS)).collect()}
    assert got[2].headers == {"content-type": "text/html", "content-length": "9", "date": "3", "vary": "x"}
    assert got[3].verdict == "no-response" and got[3].headers is None
    assert warc.resolve(spark.createDataFrame([], warc.RECORDS)).count() == 0
