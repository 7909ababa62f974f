"""Aggregates over packs: counters, totals, quantiles, samples and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwright.plans.shared import written


def counter(df: DataFrame, *keys: Column | str, limit: int | None = None) -> DataFrame:
    """Rows per key, most frequent first when limited."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), *counts.columns[:-1]).limit(limit) if limit else counts


def totals(df: DataFrame, key: str, *sums: str) -> DataFrame:
    """Rows and sums per key, missing sums as 0."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums])


def versions_seen(df: DataFrame, versions: str) -> DataFrame:
    """Rows per version; a row counts in each of its versions."""
    return df.select(F.explode(versions).alias("version")).groupBy("version").agg(F.count(F.lit(1)).alias("n"))


def position_quantile(df: DataFrame, key: str, value: str, q: float = 0.95) -> DataFrame:
    """Average and the value at sorted position int(n * q) - 1 (at least 0) of each key."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))  # equal values meet before the shuffle
    upto = F.sum("_n").over(Window.partitionBy(key).orderBy(value))
    size = F.sum("_n").over(Window.partitionBy(key))
    ranked = counts.withColumn("_upto", upto).withColumn("_size", size)
    reached = F.col("_upto") >= F.greatest(F.lit(1), F.floor(F.col("_size") * F.lit(q)))
    held = F.when(F.col(value).isNotNull(), F.col("_n"))
    return ranked.groupBy(key).agg(
        (F.sum(F.col(value) * F.col("_n")) / F.sum(held)).alias("average"), F.min(F.when(reached, F.col(value))).alias("at_quantile")
    )


def even_sample(df: DataFrame, path: str, count: int) -> DataFrame:
    """Every n//count-th row by path and always the last, count rows at most.

    Places come from a range sort, written once so that its parts are the same whenever they are read, and counts of
    its parts, so no task sees more than its range.
    """
    spark = df.sparkSession
    ordered = written(df.repartitionByRange(path).select(path, F.spark_partition_id().alias("_part")))
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")).orderBy("_part").collect()  # one row a partition
    total, before, offsets = 0, 0, []
    for r in sizes:
        offsets.append((r["_part"], before))
        before += r["_size"]
    total = before
    if not total or count <= 0:
        return df.select(path).limit(0)
    start = spark.createDataFrame(offsets, "_part int, _before long")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(path)) - 1
    placed = ordered.join(F.broadcast(start), "_part").withColumn("_at", own + F.col("_before"))
    step = max(1, total // count)
    chosen = ((F.col("_at") % step == 0) & (F.col("_at") < step * (count - 1))) | (F.col("_at") == total - 1)
    return placed.where(chosen if total > count else F.lit(True)).select(path)


def resolution(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """References, how many find their target, and the ratio."""
    keys = right.select(F.col(right_key).alias("_k")).distinct()
    met = left.select(F.col(left_key).alias("_l")).join(keys, F.col("_l") == F.col("_k"), "left")
    return met.agg(
        F.count(F.lit(1)).alias("n_refs"),
        F.count_if(F.col("_k").isNotNull()).alias("n_resolved"),
        F.round(F.count_if(F.col("_k").isNotNull()) / F.count(F.lit(1)), 6).alias("ratio"),
    )


def digest_mismatches(stored: DataFrame, source: DataFrame, path: str, data: str) -> DataFrame:
    """Paths whose stored bytes and source bytes differ, or that only one side has."""
    a = stored.select(F.col(path), F.sha2(F.col(data).cast("binary"), 256).alias("_a"))
    b = source.select(F.col(path), F.sha2(F.col(data).cast("binary"), 256).alias("_b"))
    return a.join(b, path, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(path)
