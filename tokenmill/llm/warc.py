"""Not-modified revisit resolution: as-of join by canonical URL.

A revisit (304) record is resolved by the latest earlier full response of its canonical
URL, if their validators agree: entity tags (compared weakly), else modification dates, else
payload digests. The resolved record has the response's headers, updated by those that a
304 may change.

The as-of join has no hot key: records are range-partitioned by URL, time and id, so one
URL may span many partitions. A partition is read in order with one response in hand.
Revisits at its head, whose response lies in an earlier partition, are joined with the
last response that each earlier partition passes on (one row per partition).

Defined cases: "earlier" compares time, then record id; records without URL, time or id
answer nobody and their revisits have no response; null headers are empty; names of
headers are lower-cased, the last of equal names holds; repeated rows give repeated
results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.llm.base import stored

# Response headers that a 304 may update (RFC 9110, 15.4.5; RFC 9111, 3.2).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
# Query parameters that do not name a resource.
TRACKING = r"^(utm_[a-z_]+|gclid|fbclid)="

RECORDS = "record_id long, url string, at long, full boolean, etag string, last_modified string, digest string, headers map<string,string>"


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, `www.`, default port, fragment, closing slash; other parameters sorted."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www[.]", "")
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.filter(F.split(F.regexp_extract(rest, r"[?](.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    return F.concat(host, path, F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(asked), "&"))).otherwise(""))


def _named(headers: Column) -> Column:
    """Headers with lower-case names, the last of equal names."""
    entry = F.aggregate(
        F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>")),
        F.array().cast("array<struct<key:string,value:string>>"),
        lambda acc, e: F.concat(F.filter(acc, lambda x: x["key"] != F.lower(e["key"])), F.array(F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))),
    )
    return F.map_from_entries(entry)


def _as_of(names: list[str], schema: pa.Schema):
    """Adds to each revisit the last full response before it in its partition; keeps the response to pass on."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = None  # the last full response of the URL that is being read
        last_url, open_ = None, True  # open_: no response of last_url seen in this partition yet
        first_url = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            skip = 0 if held is None else 1
            url = t["canon"].combine_chunks()
            full = t["full"].to_numpy(zero_copy_only=False).astype(bool)
            n = t.num_rows
            new = np.ones(n, bool)
            if n > 1:
                new[1:] = pc.not_equal(url.slice(1), url.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            last = np.maximum.accumulate(np.where(full, np.arange(n), -1))
            has = last >= start
            if first_url is None:
                first_url = url[0].as_py()
            # what comes before the first response of the partition's first URL may be answered by an earlier partition
            head = ~has & np.array(pc.equal(url, first_url).to_numpy(zero_copy_only=False))
            ask = ~full
            ask[:skip] = False
            at = np.flatnonzero(ask)
            source = t.take(pa.array(np.where(has[at], last[at], 0)))
            known = pa.array(has[at])
            out = [t.column(c).take(pa.array(at)).combine_chunks() for c in names]
            out += [pc.if_else(known, source.column(c).combine_chunks(), pa.scalar(None, source.schema.field(c).type)) for c in ("record_id", "etag", "last_modified", "digest", "headers")]
            out += [pa.array(head[at]), pa.array(np.full(len(at), part, np.int32)), pa.array(np.zeros(len(at), bool))]
            yield pa.RecordBatch.from_arrays(out, schema=schema)
            held = t.slice(int(last[-1]), 1).to_batches()[0] if has[-1] else None
            last_url = url[n - 1].as_py()
        if first_url is not None:
            # one row that carries on: the last URL of this partition and its last response, if any
            row = held.to_pylist()[0] if held is not None else dict.fromkeys(["record_id", "etag", "last_modified", "digest", "headers"])
            values = [None] * len(names)
            values[names.index("canon")] = last_url
            tail = [row[c] for c in ("record_id", "etag", "last_modified", "digest", "headers")]
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip([*values, *tail, False, part, True], schema)], schema=schema)

    return run


def resolve(records: DataFrame) -> DataFrame:
    """All revisits of ``records`` (see ``RECORDS``) with ``canon``, ``source_id``, ``verdict`` and merged ``headers``.

    verdict: etag, last-modified or digest (what agreed); mismatch; unchecked (nothing to compare); no-response.
    """
    names = ["record_id", "url", "canon", "at", "etag", "last_modified", "digest", "headers"]
    t = records.select("record_id", "url", canonical_url(F.col("url")).alias("canon"), "at", "etag", "last_modified", "digest", _named(F.col("headers")).alias("headers"), F.coalesce("full", F.lit(False)).alias("full"))
    usable = F.col("canon").isNotNull() & F.col("at").isNotNull() & F.col("record_id").isNotNull()
    kinds = {"record_id": pa.int64(), "at": pa.int64(), "headers": pa.map_(pa.string(), pa.string())}
    kind = lambda c: kinds.get(c, pa.string())
    source = ("record_id", "etag", "last_modified", "digest", "headers")
    schema = pa.schema([*((c, kind(c)) for c in names), *((f"source_{c}", kind(c)) for c in source), ("head", pa.bool_()), ("part", pa.int32()), ("carry", pa.bool_())])
    sql = {"record_id": "long", "at": "long", "headers": "map<string,string>"}
    columns = ", ".join([*(f"{c} {sql.get(c, 'string')}" for c in names), *(f"source_{c} {sql.get(c, 'string')}" for c in source), "head boolean", "part int", "carry boolean"])
    met = t.where(usable).repartitionByRange("canon", "at", "record_id").sortWithinPartitions("canon", "at", "record_id").mapInArrow(_as_of(names, schema), columns)
    met = stored(met, "as-of")  # partitions are fixed from here on
    # for each partition that begins with a URL it shares with earlier ones: the last response these pass on
    carry = met.where("carry").select("canon", "part", *(F.col(f"source_{c}").alias(f"passed_{c}") for c in source))
    heads = met.where("head").select("canon", "part").distinct()
    asked = heads.select("canon", "part", F.lit(True).alias("ask"), *(F.lit(None).cast(sql.get(c, "string")).alias(f"passed_{c}") for c in source)).unionByName(carry.withColumn("ask", F.lit(False)))
    earlier = Window.partitionBy("canon").orderBy("part", F.desc("ask")).rowsBetween(Window.unboundedPreceding, -1)
    passed = F.struct(*(f"passed_{c}" for c in source))
    given = asked.withColumn("p", F.last(F.when(F.col("passed_record_id").isNotNull(), passed), ignorenulls=True).over(earlier)).where("ask").select("canon", "part", "p")
    heads_done = met.where("head AND NOT carry").drop(*(f"source_{c}" for c in source)).join(given, ["canon", "part"], "left")
    heads_done = heads_done.select(*names, *(F.col(f"p.passed_{c}").alias(f"source_{c}") for c in source))
    rest = met.where("NOT head AND NOT carry").select(*names, *(f"source_{c}" for c in source))
    lost = t.where(~usable & ~F.col("full")).select(*names, *(F.lit(None).cast(sql.get(c, "string")).alias(f"source_{c}") for c in source))
    return _judged(heads_done.unionByName(rest).unionByName(lost))


def _judged(t: DataFrame) -> DataFrame:
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    pairs = [("etag", weak(F.col("etag")), weak(F.col("source_etag"))), ("last-modified", F.col("last_modified"), F.col("source_last_modified")), ("digest", F.col("digest"), F.col("source_digest"))]
    verdict = F.when(F.col("source_record_id").isNull(), "no-response")
    for name, a, b in pairs:
        verdict = verdict.when(a.isNotNull() & b.isNotNull(), F.when(a == b, name).otherwise("mismatch"))
    t = t.withColumn("verdict", verdict.otherwise("unchecked"))
    good = F.col("verdict").isin("etag", "last-modified", "digest")
    update = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    stays = F.map_filter("source_headers", lambda k, v: ~F.array_contains(F.map_keys(update), k))
    return t.select("record_id", "url", "canon", "at", "verdict", F.when(good, F.col("source_record_id")).alias("source_id"), F.when(good, F.map_concat(stays, update)).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Records derived from `pages`: of each page a full response, a later revisit and one just before the response."""
    p = F.col("page_id")
    body = F.coalesce("html", F.lit(""))
    base = pages.select(p, "url", F.md5(body.cast("binary")).alias("digest"), F.octet_length(body).cast("string").alias("size"))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), F.floor(p / 7).cast("string"))
    head = lambda *kv: F.map_from_arrays(F.array(*(F.lit(k) for k in kv[::2])), F.array(*(v if isinstance(v, Column) else F.lit(v) for v in kv[1::2])))
    tracked = F.concat(F.regexp_replace("url", "^http://", "HTTP://"), F.when(F.col("url").contains("?"), "&utm_campaign=x").otherwise("?utm_campaign=x"))
    none = F.lit(None).cast("string")
    full = base.select((4 * p).alias("record_id"), "url", (10 * p).alias("at"), F.lit(True).alias("full"), F.when(p % 5 != 4, tag).alias("etag"), day.alias("last_modified"), "digest", head("Content-Type", "text/html", "Content-Length", F.col("size"), "Cache-Control", "max-age=60", "Date", (10 * p).cast("string")).alias("headers"))
    asked = F.when(p % 4 == 0, F.concat(F.lit("W/"), tag)).when(p % 4 == 1, tag).when(p % 4 == 3, F.lit('"stale"'))
    later_at = 10 * (p + 1 + p % 7) + 3
    later = base.select((4 * p + 1).alias("record_id"), tracked.alias("url"), later_at.alias("at"), F.lit(False).alias("full"), asked.alias("etag"), F.when(p % 4 == 2, day).alias("last_modified"), none.alias("digest"), head("cache-control", "max-age=120", "Content-Length", "0", "Date", later_at.cast("string"), "Vary", "accept").alias("headers"))
    before = base.select((4 * p + 2).alias("record_id"), "url", (10 * p - 5).alias("at"), F.lit(False).alias("full"), tag.alias("etag"), day.alias("last_modified"), "digest", head("Date", (10 * p - 5).cast("string")).alias("headers"))
    return full.unionByName(later).unionByName(before)


def header_lines(headers: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))), "\n")
