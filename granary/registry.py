"""The points at which models come in, and what stands in for each of them without one.

Each is a function over tables, so an implementation may be an expression, a pandas UDF or a call to a service:
a router adds a distribution, an embedder makes vectors, an answer model drafts, a provider renders and judges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import answering, rag
from granary.operators.assembling import rendered
from granary.operators.rules import route

KINDS = ("router", "embedder", "answer_model", "provider")
_known: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, make: Callable) -> None:
    """``make(**settings)`` gives the implementation."""
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}; there are {', '.join(KINDS)}")
    _known[kind, name] = make


def get(kind: str, name: str, **settings):
    if (kind, name) not in _known:
        raise KeyError(f"no {kind} {name!r}; there are {sorted(n for k, n in _known if k == kind)}")
    return _known[kind, name](**settings)


def rule_router(rules: dict[str, dict[str, list]]) -> Callable[[DataFrame], DataFrame]:
    """Keyword rules of each record's domain: adds names, p, pred, conf, said and rule."""

    def run(df: DataFrame) -> DataFrame:
        out = None
        for domain, cues in rules.items():
            part = route(df.where(F.col("domain") == domain), cues, "message").withColumn("names", F.array(*map(F.lit, cues)))
            part = part.select(*df.columns, "names", "p", "pred", "conf", F.col("clar").alias("said"), "rule")
            out = part if out is None else out.union(part)
        return out

    return run


class DryRun:
    """Renders scenarios without a model, and judges records as their labels say."""

    def __init__(self, seed: str = "dry"):
        self.seed = seed

    def render(self, scenarios: DataFrame) -> DataFrame:
        key = F.col("scenario_id")
        visible = F.map_filter("facts", lambda k, v: F.array_contains("visible_facts", k))
        return scenarios.select(key, rendered(visible, self.seed, key).alias("message"), F.lit("dry_run").alias("provider"), F.lit("dry-run").alias("model"), F.lit("none").alias("prompt_version"), F.lit(0).cast("long").alias("line"))

    def judge(self, records: DataFrame) -> DataFrame:
        return records.select("record_id", "labels.issue", "labels.clarification_needed", F.lit(True).alias("language_ok"), F.lit("dry-run").alias("model"), F.lit(True).alias("mock"), F.lit(0).cast("long").alias("line"))


def answer(questions: DataFrame, chunks: DataFrame, embedder: rag.Embedder, draft: Callable[[DataFrame], DataFrame], k: int, least: float) -> DataFrame:
    """Cited answers in a batch: retrieve, gate, draft, check the citations. ``chunks`` has chunk_id, doc_id, domain, text and
    embedding."""
    hits = rag.retrieve(questions, chunks, embedder, k).join(chunks.select("chunk_id", "doc_id", X.collapse(F.col("text")).alias("text")), "chunk_id")
    return answering.respond(questions, hits, draft(hits), least)


def decide(df: DataFrame, router: Callable[[DataFrame], DataFrame], fallback: str, ask_from: float, least: float, now: str, version: str) -> DataFrame:
    """Routing in a batch: text in; intent, confidence, decision and the row of the request log out."""
    routed = router(df)
    asks = (F.col("said") >= ask_from) | (F.col("conf") < least)
    return routed.select(
        *df.columns, F.col("pred").alias("intent"), F.round("conf", 4).alias("confidence"), asks.alias("needs_clarification"),
        answering.act(F.col("said"), F.col("conf"), ask_from, least).alias("decision"), (F.col("pred") == fallback).alias("is_fallback"),
        answering.script_name(F.col("message")).alias("script"), F.sha2("message", 256).alias("text_hash"), F.lit(now).cast("timestamp").alias("created_at"), F.lit(version).alias("model_version"),
    )


register("router", "rules", rule_router)
register("embedder", "bag-of-words", rag.bag_of_words)
register("answer_model", "extractive", lambda: answering.extractive)
register("provider", "dry_run", DryRun)
