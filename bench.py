"""Benchmark of the headline plans; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is forced with a full action (count / write / collect of an aggregate).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import functions as F

    from tokenmill.session import local_session, scratch_path

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16, app="tokenmill-bench")

    from tokenmill.operators import vocab as V
    from tokenmill.operators.pairs import conversation_pairs
    from tokenmill.operators.scoring import loss_accuracy
    from tokenmill.plans import corpus as C
    from tokenmill.plans.scoring import scored
    from tokenmill.sources.readers import read_table
    from tokenmill.sources.sinks import write_shards
    from tokenmill.operators.shards import shuffle_key

    times: dict[str, float] = {}
    extra: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        return out

    # warm-up: JVM, Python workers
    spark.range(1000).selectExpr("sum(id)").collect()

    docs = C.documents(spark, sf_dir)
    n_docs = timed("scan_documents", lambda: docs.count())
    timed("word_counts", lambda: V.word_counts(docs).agg(F.sum("count")).collect())
    ctx = timed("vocabulary", lambda: C.build_context(spark, sf_dir))
    enc = C.encoded_documents(ctx)
    n_tokens = timed("encode_documents", lambda: enc.agg(F.sum(F.size("ids"))).collect()[0][0])
    extra["documents_per_s"] = round(n_docs / times["encode_documents"], 1)
    extra["tokens_per_s"] = round(n_tokens / times["encode_documents"], 1)
    n_rows = sum(r["rows"] for r in timed("shard_counts", lambda: C.shard_counts(ctx).collect()))
    path = scratch_path(spark, "bench-shards")
    timed("write_shards", lambda: write_shards(shuffle_key(C.masked_rows(ctx)), path, total_rows=n_rows, rows_per_file=10_000))
    extra["masked_rows_per_s"] = round(n_rows / times["write_shards"], 1)
    conv = read_table(spark, sf_dir, "conversations")
    timed("pairs_padded", lambda: C.padded_pairs(ctx, conversation_pairs(conv)).agg(F.sum(F.size("ids"))).collect())
    timed("scoring", lambda: loss_accuracy(scored(spark, sf_dir)).collect())
    t0 = time.time()
    res = V.train_vocabulary(V.word_counts(docs), vocab_size=180, min_frequency=2)
    times["train_vocab"] = round(time.time() - t0, 3)
    extra["train_vocab_s_per_round"] = round(times["train_vocab"] / max(res.rounds, 1), 3)

    total = round(sum(times.values()), 3)
    sf_name = os.path.basename(sf_dir.rstrip("/"))
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": sf_name.replace("sf", ""),
                "throughput": extra,
            }
        )
    )


if __name__ == "__main__":
    main()
