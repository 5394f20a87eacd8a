"""Files of records, scenarios, verdicts and evaluation questions as typed tables, and files of cached outputs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import content_hash
from granary.operators.rag import sound_questions
from granary.operators.validation import sound
from granary.sources.jsonlines import read_lines, write_lines

LABELS = "STRUCT<issue: STRING, issue_target: MAP<STRING, DOUBLE>, clarification_needed: BOOLEAN>"
RECORD = (
    "record_id STRING, scenario_id STRING, scenario_group_id STRING, domain STRING, taxonomy_version STRING, scenario_facts MAP<STRING, STRING>, visible_facts ARRAY<STRING>, "
    f"withheld_facts ARRAY<STRING>, message STRING, script STRING, style_tags ARRAY<STRING>, difficulty_family STRING, labels {LABELS}, issues_all ARRAY<STRING>, stated_priority STRING, "
    "source STRUCT<generator: STRING, provider: STRING, model: STRING, prompt_version: STRING, seed: BIGINT>, derivation STRUCT<parent_record_id: STRING, ops: ARRAY<STRING>>, "
    "verifier_agrees BOOLEAN, adjudicator_agrees BOOLEAN, status STRING, reason STRING, content_hash STRING"
)
SCENARIO = (
    "scenario_id STRING, scenario_group_id STRING, domain STRING, taxonomy_version STRING, family STRING, issue STRING, issue_target MAP<STRING, DOUBLE>, clarification_needed BOOLEAN, issues_all ARRAY<STRING>, "
    "stated_priority STRING, facts MAP<STRING, STRING>, visible_facts ARRAY<STRING>, withheld_facts ARRAY<STRING>, style STRUCT<length: STRING, tone: STRING, formality: STRING>, instructions STRING"
)
RENDERING = "scenario_id STRING, message STRING, provider STRING, model STRING, prompt_version STRING, line BIGINT"
VERDICT = "record_id STRING, issue STRING, clarification_needed BOOLEAN, language_ok BOOLEAN, model STRING, mock BOOLEAN, line BIGINT"
QUESTION = "question_id STRING, domain STRING, script STRING, question STRING, gold_doc_ids ARRAY<STRING>, must_refuse BOOLEAN"


def first_fault(spark: SparkSession, path: str) -> str | None:
    """``file:line`` of the first line that is not a JSON object, or None. Lines are numbered within files,
    so each file is one row here; call it to explain a failed read."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("f"), F.posexplode(F.split("value", "\n")).alias("n", "t"))
    bad = files.where(~F.col("t").rlike(r"^\s*$") & ~(F.col("t").rlike(r"^\s*\{") & F.try_parse_json("t").isNotNull()))
    row = bad.agg(F.min(F.struct("f", "n")).alias("m")).first()["m"]
    return None if row is None else f"{row['f']}:{row['n'] + 1}"


def checked(df: DataFrame, ok, what: str, key: str) -> DataFrame:
    """``df``; a row for which ``ok`` is not true is an error that names it."""
    return df.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(F.col(key), F.lit("?"))))))


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file, each of them sound; what a file leaves out is null, empty lists and a missing hash are filled in."""
    r = read_lines(spark, path, RECORD)
    none = F.array().cast("array<string>")
    r = r.withColumns({c: F.coalesce(c, none) for c in ("visible_facts", "withheld_facts", "style_tags", "issues_all")})
    r = r.withColumn("content_hash", F.when(F.coalesce("content_hash", F.lit("")) == "", content_hash(F.col("message"))).otherwise(F.col("content_hash")))
    return checked(r, sound(), "not a sound record", "record_id")


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions: gold documents or a refusal, and a known script."""
    return checked(read_lines(spark, path, QUESTION), sound_questions(), "needs gold documents or must_refuse, and a known script", "question_id")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a file of JSON lines; none where there is no file yet."""
    try:
        return read_lines(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def append(df: DataFrame, path: str) -> int:
    return write_lines(df, path, append=True)
