"""What the query modules share: table access, the registry, and how engine concepts map to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.hashing import uniform
from granary.operators.metrics import brier
from granary.operators.rules import route

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Stop-word cues of the language router, in the order of its categories.
CUES = {
    "en": [" the ", " and ", " of ", " that "],
    "fr": [" le ", " les ", " des ", " que "],
    "de": [" der ", " und ", " nicht ", " die "],
    "es": [" el ", " los ", " para ", " por "],
    "other": [],
}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def group_of(doc_id: Column) -> Column:
    return F.concat(F.lit("g"), F.lpad(F.floor(doc_id / 4).cast("string"), 9, "0"))


SQL_GROUP = "'g' || lpad(CAST(doc_id // 4 AS VARCHAR), 9, '0')"
SQL_NORM = r"trim(regexp_replace(regexp_replace(translate(lower(nfc_normalize(text)), '०१२३४५६७८९', '0123456789'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def sql_uniform(seed: str, key: str) -> str:
    return f"(CAST(('0x' || substr(sha256('{seed}:' || {key}), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, gold, pred, correct, conf, p_gold, brier, clar, rule, source, text of the rule router over documents."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("gold"), "source")
    routed = route(docs, CUES)
    place = F.array_position(F.array(*map(F.lit, CUES)), F.col("gold")).cast("int")
    return routed.select(
        "*",
        (F.col("pred") == F.col("gold")).alias("correct"),
        F.coalesce(F.get("p", place - 1), F.lit(0.0)).alias("p_gold"),
        brier("p", list(CUES), "gold").alias("brier"),
    )


def _sql_predictions() -> str:
    names = list(CUES)
    score = {c: " + ".join(f"CAST(contains(lower(text), '{t}') AS INT)" for t in CUES[c]) or "0" for c in names}
    s = ", ".join(f"{score[c]} AS s_{c}" for c in names)
    total, listed = " + ".join(f"s_{c}" for c in names), ", ".join(f"s_{c}" for c in names)
    p = ", ".join(f"CASE WHEN total = 0 THEN {1 / len(names)} ELSE (s_{c} + 0.05) / (total + 0.25) END AS p_{c}" for c in names)
    best = "CASE " + " ".join(f"WHEN p_{c} = conf THEN '{c}'" for c in names) + " END"
    gold = "CASE gold " + " ".join(f"WHEN '{c}' THEN p_{c}" for c in names) + " ELSE 0 END"
    square = " + ".join(f"(p_{c} - CASE WHEN gold = '{c}' THEN 1 ELSE 0 END) ** 2" for c in names)
    return f"""s AS (SELECT doc_id, text, lang AS gold, source, {s} FROM documents),
    t AS (SELECT *, {total} AS total, list_reverse_sort([{listed}]) AS ranked FROM s),
    p AS (SELECT *, {p} FROM t),
    c AS (SELECT *, greatest({", ".join(f"p_{c}" for c in names)}) AS conf FROM p),
    pred AS (SELECT *, {best} AS pred, {gold} AS p_gold, {square} AS brier, {best} = gold AS correct,
      CASE WHEN total = 0 THEN 0.9 WHEN ranked[1] = ranked[2] THEN 0.6 ELSE 0.1 END AS clar,
      CASE WHEN total = 0 THEN 'no cue' WHEN ranked[1] = ranked[2] THEN 'tie' ELSE 'match' END AS rule FROM c)"""


PRED = _sql_predictions()
u = uniform
