"""Aggregations: shard counts, corpus statistics, step plan, label / epoch metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.plans.numbering import index_by_order


def shard_counts(df: DataFrame, shard_col: str = "shard") -> DataFrame:
    return df.groupBy(shard_col).agg(F.count(F.lit(1)).alias("rows"))


def corpus_stats(sequences: DataFrame, sequence_size: int = 128, batch_size: int = 128) -> DataFrame:
    """sequences, tokens = sequences x size, microbatches = ceil(sequences / batch)."""
    n = F.count(F.lit(1))
    return sequences.agg(
        n.alias("sequences"),
        (n * sequence_size).alias("tokens"),
        F.ceil(n / batch_size).cast("long").alias("microbatches"),
    )


def step_plan(stats: DataFrame, peak_batches_accumulated: int = 32) -> DataFrame:
    """Optimizer steps with accumulation growing linearly to the peak: microbatches x 2 / (peak - 1)."""
    return stats.withColumn(
        "steps", F.floor(F.col("microbatches") * 2 / (peak_batches_accumulated - 1)).cast("long")
    )


def label_distribution(df: DataFrame, label_col: str = "gold_label", group_cols=()) -> DataFrame:
    return df.groupBy(*group_cols, label_col).agg(F.count(F.lit(1)).alias("rows"))


def metrics_from_events(events: DataFrame, run: str = "events") -> DataFrame:
    """Logged values as run metrics: ``run, epoch, step, name, value`` (epoch = calendar day)."""
    return events.select(
        F.lit(run).alias("run"),
        F.to_date("ts").cast("string").alias("epoch"),
        F.col("event_id").alias("step"),
        F.col("event_type").alias("name"),
        F.col("value"),
    )


def epoch_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("run", "epoch", "name").agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n"))


def mean_of_batch_means(metrics: DataFrame, batch_size: int, group_cols=("run", "epoch", "name"), order_col="step") -> DataFrame:
    """Mean per whole batch (in step order), then the mean of those means; short last batches are left out."""
    group_cols = list(group_cols)
    indexed = index_by_order(metrics, [order_col], out="__r", group_cols=group_cols)
    sizes = metrics.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("__n"))
    full = indexed.join(sizes, group_cols).filter(
        F.col("__r") < F.floor(F.col("__n") / batch_size) * batch_size
    )
    per_batch = full.withColumn("batch_no", F.floor(F.col("__r") / batch_size)).groupBy(*group_cols, "batch_no").agg(
        F.avg("value").alias("batch_mean")
    )
    return per_batch.groupBy(*group_cols).agg(
        F.avg("batch_mean").alias("mean_of_batch_means"), F.count(F.lit(1)).alias("batches")
    )


def max_length(df: DataFrame, ids_col: str = "ids") -> DataFrame:
    return df.agg(F.max(F.size(ids_col)).alias("max_length"))
