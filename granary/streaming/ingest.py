"""Idempotent ingestion of a stream: the first request of a key is stored, later ones replay it or conflict with it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.logs import ingest
from granary.operators.workspace import shared_dir


def ingest_stream(requests: DataFrame, key: str, body: Column, order: list[str], out: str | None = None) -> DataFrame:
    """Take what has arrived of the stream ``requests`` and return all its rows with their ``outcome``.

    What each key stored is a table beside the checkpoint, one folder for each batch: a batch reads those of earlier
    batches and overwrites its own, so one that is run again after a failure gives the same result. A key's first row is
    found by a combined minimum, so a hot key is no single task. Give ``out`` to go on from an earlier run."""
    spark = requests.sparkSession
    out = out or f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    rows = requests.withColumn("_sent", body)
    kept = f"`{key}` {dict(rows.dtypes)[key]}, _stored {dict(rows.dtypes)['_sent']}, batch BIGINT"
    mark = f"{out}/stored/batch=-1"

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        session.createDataFrame([], ", ".join(kept.split(", ")[:-1])).write.mode("overwrite").parquet(mark)
        earlier = session.read.schema(kept).parquet(f"{out}/stored").where(F.col("batch") < number).drop("batch")
        judged = ingest(batch, key, F.col("_sent"), order).withColumnRenamed("outcome", "_here").join(earlier, key, "left")
        before = F.when(F.col("_stored") == F.col("_sent"), "replay").otherwise("conflict")
        outcome = F.when(F.col("_stored").isNull(), F.col("_here")).otherwise(before)
        judged.withColumn("outcome", outcome).drop("_here").write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        done = session.read.parquet(f"{out}/rows/batch={number}")
        new = done.where(F.col(key).isNotNull() & F.col("_stored").isNull() & (F.col("outcome") == "stored"))
        new.select(key, F.col("_sent").alias("_stored")).write.mode("overwrite").parquet(f"{out}/stored/batch={number}")

    stream = rows.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("_sent", "_stored", "batch")
