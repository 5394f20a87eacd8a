"""Request-log statistics and idempotent ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.joins import counted_join


def trailing(df: DataFrame, now: str, hours: int, ts: str) -> DataFrame:
    """Rows of the last ``hours`` (1 to 720) before ``now``; the bound reaches the scan."""
    if not 1 <= hours <= 720:
        raise ValueError("hours must be from 1 to 720")
    end = F.lit(now).cast("timestamp_ntz")
    return df.where((F.col(ts) >= end - F.expr(f"INTERVAL {hours} HOUR")) & (F.col(ts) <= end))


def window_stats(df: DataFrame, now: str, hours: int, ts: str, latency: str, flag: Column) -> DataFrame:
    w = trailing(df, now, hours, ts)
    return w.agg(
        F.count("*").alias("n"), F.round(F.percentile(latency, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(latency, F.lit(0.95)), 6).alias("p95"),
        F.round(F.avg(flag.cast("int")), 6).alias("clarification_rate"),
    )


def by_intent(df: DataFrame, now: str, hours: int, ts: str, channel: str, intent: str) -> DataFrame:
    return trailing(df, now, hours, ts).groupBy(F.col(channel).alias("channel"), F.col(intent).alias("intent")).agg(F.count("*").alias("n"))


def ingest(df: DataFrame, key: str, body: Column, order: list[str]) -> DataFrame:
    """Add ``outcome``: stored for the first row of a key and for rows without one, replay for the same body again,
    conflict for another. The first row is found by a combined minimum and joined to a hot key's rows where they are; rows
    without a key are not joined at all."""
    rows = df.withColumn("_body", body)
    keyed = rows.where(F.col(key).isNotNull())
    first = keyed.groupBy(key).agg(F.min(F.struct(*order, "_body")).alias("_first"), F.count("*").alias("_n"))
    joined = counted_join(keyed, first, key, "_n", keyed.count())
    free = rows.where(F.col(key).isNull()).withColumn("outcome", F.lit("stored")).drop("_body")
    same = F.lit(True)
    for c in order:
        same = same & (F.col(c) == F.col(f"_first.{c}"))
    outcome = F.when(same, "stored").when(F.col("_body") == F.col("_first._body"), "replay").otherwise("conflict")
    return joined.withColumn("outcome", outcome).drop("_body", "_first").unionByName(free)
