"""From raw documents to token counts: five stages, each a training-data operator whose decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.bpe_codec import encode_documents
from granary.llm.decontam import find_benchmark
from granary.llm.line_dedup import dedup_lines
from granary.llm.simhash import near_duplicates
from granary.llm.toxicity import TOXIC, fit, scorer
from granary.operators.workspace import materialize


def _keyed(docs: DataFrame) -> DataFrame:
    """``(row, _key, text)``: rows as structs, so that columns of any name ride along, and what tells them apart: id (nulls
    last) and text."""
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), hashed.alias("text"))
    return docs.select(F.struct("*").alias("row"), key.alias("_key"), F.col("text"))


def _same_key(left: str, right: str):
    same = lambda f: F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}"))
    return same("last") & same("id") & same("text")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below TOXIC; the others go. Null texts score as empty ones; rows that repeat stay or go
    together, and without labels or documents nothing goes."""
    score = scorer(fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.where(score(F.coalesce("text", F.lit(""))) < TOXIC)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur earlier in the corpus; those of which nothing at all is left go, so no text is
    lost that is not elsewhere. ``n_chars`` follows the new text. Documents without words, null and empty ones among them,
    stay as they are; rows that repeat an id and text get the same result."""
    done = dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the least id (nulls last). Rows that repeat id and text count
    once; where their other columns differ, the least by a hash of the row stays. Null, empty and blank texts are one
    component. A document of very many words has one fingerprint like others; an empty table gives an empty result."""
    keyed = _keyed(docs)
    found = near_duplicates(keyed, id_col="_key")
    kept = found.where(_same_key("_key", "component_id")).select(F.col("_key").alias("_kept")).distinct()
    chosen = keyed.join(kept, _same_key("_key", "_kept"), "left_semi")
    return chosen.groupBy("_key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of any benchmark item occurs. The operator calls a document contaminated from two items
    on; here a single one is enough, since a passage of one item is a leak of that item already. Null and empty texts,
    and all documents where the benchmark is empty, stay; rows that repeat stay or go together."""
    keyed = _keyed(docs)
    found = find_benchmark(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_key", least_items=1)
    rejected = found.where("contaminated").select(F.col("_key").alias("_bad")).distinct()
    return keyed.join(rejected, _same_key("_key", "_bad"), "left_anti").select("row.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, encoded and decoded: a row a row, a null text as an empty one, whatever
    the length; an empty table gives an empty result."""
    return encode_documents(docs, with_ids=False)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("bpe", bpe),
]

#: SQL cannot express the trees, the linked lines or the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
