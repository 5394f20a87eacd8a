"""Leakage-safe splits: whole clusters fall into splits by a hash of their name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.hashing import uniform

#: Split names and shares.
SPLITS = [("train", 0.80), ("dev", 0.05), ("calib", 0.05), ("test", 0.10)]


def _edges() -> list[tuple[str, float]]:
    out, edge = [], 0.0
    for name, share in SPLITS[:-1]:
        edge += share
        out.append((name, edge))
    return out


def assign(df: DataFrame, cluster: str, seed: str) -> DataFrame:
    draw, out = uniform(seed, F.col(cluster)), F.lit(SPLITS[-1][0])
    for name, edge in reversed(_edges()):
        out = F.when(draw < edge, name).otherwise(out)
    return df.withColumn("split", out)


def sql_assign(draw: str) -> str:
    return "CASE " + " ".join(f"WHEN {draw} < {edge!r} THEN '{name}'" for name, edge in _edges()) + f" ELSE '{SPLITS[-1][0]}' END"
