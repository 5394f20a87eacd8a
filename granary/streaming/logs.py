"""The request log as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.workspace import shared_dir


def read_events(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")


def daily_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums by day and type, kept by an event-time aggregation that takes what has arrived and stops."""
    events = read_events(spark, d).withColumn("t", F.col("ts").cast("timestamp"))
    stats = events.withWatermark("t", "1 day").groupBy(F.window("t", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table/batch={number}")

    query = stats.writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    # a window's last update counts; state behind the watermark is dropped
    updates = spark.read.parquet(f"{out}/table").groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("u"))
    done = updates.select("window", "event_type", "u.*")
    return done.select(F.col("window.start").cast("date").cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
