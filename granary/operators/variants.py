"""Records derived from others: romanized variants of a share of the Devanagari ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.hashing import uniform
from granary.functions.romanize import Tables, romanize
from granary.operators.records import findings


def derive_roman(records: DataFrame, tables: Tables, share: float, seed: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """The children of a seeded share of the records whose script is deva, with ``status`` and ``reasons`` of the checks.

    Records carry record_id, scenario_id, message, script and style_tags; a child keeps every other column, labels and
    group among them, and says what it comes from (``parent_id``, ``ops``). ``rules`` are checks of the child's columns."""
    chosen = records.where((F.col("script") == "deva") & (uniform(f"{seed}:roman", F.col("record_id")) < share))
    made = chosen.withColumn("_made", romanize(tables, f"{seed}:typed")(F.col("message"), F.col("record_id").cast("string")))
    mock = F.array_contains("style_tags", "mock")
    tags = F.concat(F.array_remove("style_tags", "mock"), F.array(F.lit("derived")), F.when(mock, F.array(F.lit("mock"))).otherwise(F.array().cast("array<string>")))
    child = made.select(
        *(c for c in records.columns if c not in ("record_id", "message", "script", "style_tags")),
        F.col("record_id").alias("parent_id"), F.concat("scenario_id", F.lit("-roman")).alias("record_id"), F.col("_made.text").alias("message"),
        F.lit("roman").alias("script"), tags.alias("style_tags"), F.col("_made.ops").alias("ops"),
    )
    return findings(child, rules, F.lit(False))


def operation_counts(children: DataFrame) -> DataFrame:
    """``(op, n)``: how often each habit, English levels by name, shaped the accepted children."""
    ops = children.where("status = 'accepted'").select(F.explode("ops").alias("o"))
    name = F.when(F.col("o").startswith("english_level:"), F.col("o")).otherwise(F.substring_index("o", ":", 1))
    return ops.groupBy(name.alias("op")).agg(F.count("*").alias("n"))
