"""The queries of this subpackage, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.line_dedup import dedup_lines

    done = dedup_lines(_read(spark, sf_dir, "documents"))
    return done.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        "n_removed",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.toxicity import score_toxicity

    return score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.pii import find_personal_data

    return find_personal_data(_read(spark, sf_dir, "documents")).drop("found")


def op4_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.simhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.bpe_codec import encode_documents

    return encode_documents(_read(spark, sf_dir, "documents"), with_ids=False)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.quality import judge_quality

    return judge_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.token_counts import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.decontam import find_benchmark

    return find_benchmark(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.sharding import shard_by_bytes

    return shard_by_bytes(_read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.warc import build_derivatives, responses_from_pages

    records = build_derivatives(responses_from_pages(_read(spark, sf_dir, "pages")), id_col="page_id")
    return records.select(
        "page_id",
        "warc_type",
        "record_id",
        "refers_to",
        "target_uri",
        "warc_date",
        "content_type",
        "content_length",
        "block_digest",
        "source_payload_digest",
        F.to_json("source_headers").alias("source_headers"),
        F.sha2("block", 256).alias("block_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_line_dedup,
        op2_toxicity,
        op3_pii,
        op4_simhash_bk,
        op5_bpe_codec,
        op6_quality,
        op7_token_counts,
        op8_decontam,
        op9_sharding,
        op10_warc,
    )
    return {f.__name__: f for f in found}


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
#: Every window of every item against every window of every document, of each length that items have.
OP8_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
  n AS (SELECT item, w, least(len(w), 8) AS size FROM b WHERE len(w) > 0),
  iw AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM n, range(1, len(w) - size + 2) r(i)),
  sizes AS (SELECT DISTINCT size FROM iw),
  dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM d, sizes, range(1, greatest(len(w) - size, -1) + 2) r(i)),
  met AS (SELECT DISTINCT doc_id, item, i, dw.size FROM dw JOIN iw ON dw.size = iw.size AND dw.win = iw.win),
  hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM met, range(i, i + size) r(k) GROUP BY doc_id),
  ids AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(ids.n, 0) >= 2 AS contaminated
  FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op8_decontam": OP8_SQL}
