"""Greedy packing of ordered blocks into chunks of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(df: DataFrame, key: str, order: str, text: str, limit: int, joiner: str = "\n\n") -> DataFrame:
    """``(key, position, chunk)``: blocks of a document joined while the chunk stays within ``limit`` characters. A longer
    block is a chunk of its own. The fold runs inside one row, so a document's blocks must fit in memory."""
    blocks = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("b"))

    def step(a, b):
        fits = F.length(a["last"]) + len(joiner) + F.length(b["t"]) <= limit
        joined = F.struct(a["done"].alias("done"), F.concat(a["last"], F.lit(joiner), b["t"]).alias("last"))
        fresh = F.struct(F.concat(a["done"], F.array(a["last"])).alias("done"), b["t"].alias("last"))
        return F.when(a["last"].isNull(), F.struct(a["done"].alias("done"), b["t"].alias("last"))).when(fits, joined).otherwise(fresh)

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("last"))
    packed = blocks.select(key, F.aggregate("b", start, step, lambda a: F.concat(a["done"], F.array(a["last"]))).alias("c"))
    return packed.select(key, F.posexplode("c").alias("position", "chunk")).withColumn("position", F.col("position").cast("long"))
