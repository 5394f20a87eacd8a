"""Seeded samples that depend on keys alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stratified(df: DataFrame, bucket: list[str], draw: Column, tie: str, share: float, rounding: Column) -> DataFrame:
    """Add ``chosen``: a share of each bucket, rounded up or down by the bucket's own draw."""
    placed = df.withColumn("_u", draw)
    rank = F.row_number().over(Window.partitionBy(*bucket).orderBy("_u", tie))
    n = F.count("*").over(Window.partitionBy(*bucket))
    return placed.withColumn("chosen", rank <= F.floor(n * share + rounding)).drop("_u")


def spread(df: DataFrame, bucket: list[str], draw: Column, bucket_draw: Column, key: str, n: int) -> DataFrame:
    """``n`` keys, one from each bucket in turn: a top-n over (round, bucket draw), so no task sees all rows."""
    placed = df.select(key, *bucket, draw.alias("_u"), bucket_draw.alias("_b"))
    rank = F.row_number().over(Window.partitionBy(*bucket).orderBy("_u", key))
    return placed.withColumn("_r", rank).orderBy("_r", "_b", key).limit(n).select(key)


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``(key, quota)``: whole shares of ``total`` in proportion to the weights; for tables of a few keys."""
    everything = Window.partitionBy()
    exact = F.col(weight) * float(total) / F.sum(weight).over(everything)
    w = weights.select(key, exact.alias("x")).select(key, F.floor("x").alias("base"), F.round(F.col("x") - F.floor("x"), 9).alias("frac"))
    w = w.select(key, "base", F.row_number().over(Window.orderBy(F.desc("frac"), key)).alias("k"), F.sum("base").over(everything).alias("given"))
    return w.select(key, (F.col("base") + F.when(F.col("k") <= total - F.col("given"), 1).otherwise(0)).alias("quota"))
