"""Connected components of a link table, by alternating star contractions.

Large-star and small-star turn every component into a star around its smallest node in
a number of rounds that grows with the logarithm of its size. Each round is written to
the shared folder, so lineage stays short and a lost executor costs one round at most.
A node with very many links is a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.base import stored


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, root``: every linked node with the smallest node it reaches; roots are left out."""
    e = links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct()
    e = stored(e, "links")
    mark = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).collect()[0]
        if now[0] == 0 or now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
        e = stored(_small_star(_large_star(e).distinct()).distinct(), "links")
