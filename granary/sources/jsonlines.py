"""JSON lines and JSON arrays, and the digest of a file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from granary.operators.exporting import numbered


def read_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """Objects of a JSON-lines file, blank lines skipped; a line that is not JSON is an error naming file and line text."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file")).where(r"NOT value RLIKE '^\\s*$'")
    parsed = lines.select("value", "_file", F.from_json("value", f"{_ddl(schema)}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    wrong = F.concat(F.col("_file"), F.lit(": not a record: "), F.substr("value", F.lit(1), F.lit(200)))
    sound = F.when(F.col("r._bad").isNotNull(), F.raise_error(wrong)).otherwise(F.lit(True))
    return parsed.where(sound).select("r.*").drop("_bad")


def _ddl(schema) -> str:
    return schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def write_lines(df: DataFrame, path: str, append: bool = False) -> int:
    """Write rows as JSON lines, nulls included; returns how many there were."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)
    return seen.get["n"]


def read_array(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of a file that holds one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_indexed(df: DataFrame, order: str, body: str, index: list[str], path: str) -> int:
    """Write ``body`` (JSON text) line by line in the order of a column to ``path``/lines, and line number with the index
    columns to ``path``/index; files are in order, one after another."""
    rows = numbered(df, order, "line")
    rows.repartitionByRange("line").sortWithinPartitions("line").select(F.col(body).alias("value")).write.mode("overwrite").text(f"{path}/lines")
    return write_lines(rows.select("line", *index), f"{path}/index")


def join_back(answers: DataFrame, index: DataFrame, questions: list[str], id_col: str = "id") -> DataFrame:
    """Answers named ``prefix/line`` with a ``question`` joined to their index rows, one column ``value`` per question."""
    placed = answers.withColumn("line", F.element_at(F.split(id_col, "/"), -1).cast("long"))
    wide = placed.groupBy("line").agg(*(F.max(F.when(F.col("question") == q, F.col("value"))).alias(q) for q in questions))
    return index.join(wide, "line")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sha256)`` of files up to 2 GB each."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
