"""Declarative checks of records, their status, and work that is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def findings(df: DataFrame, rules: list[tuple[str, Column]], disputed: Column) -> DataFrame:
    """Add ``reasons`` (names of the broken rules, in the order given) and ``status``: rejected with any reason, else
    queued where ``disputed`` is true, else accepted. A rule that is null counts as kept."""
    reasons = F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules)))
    df = df.withColumn("reasons", reasons)
    waiting = F.coalesce(disputed, F.lit(False))
    return df.withColumn("status", F.when(F.size("reasons") > 0, "rejected").when(waiting, "queued").otherwise("accepted"))


def pending(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Work without a finished counterpart."""
    return work.join(done.select(*key).distinct(), key, "left_anti")


def batches(df: DataFrame, part: list[str], order: list[str], size: int) -> DataFrame:
    """Number consecutive runs of ``size`` rows within each part."""
    place = F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(place / size))


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
