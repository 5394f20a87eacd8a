"""Retrieval and cited answers judged: embedders, ranks, gates, answers, caches and the store of chunks."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import metrics as M
from granary.operators.evaluating import normalised
from granary.operators.retrieval import top_k
from granary.operators.sync import plan

REASONS = ("low_similarity", "model_declined", "no_valid_citation")


# --- embedding


@dataclass(frozen=True)
class Embedder:
    """What makes vectors of texts: a column expression, with what a model wants before questions and passages."""

    name: str
    dim: int
    embed: Callable[[Column], Column]
    query_prefix: str = ""
    passage_prefix: str = ""

    def queries(self, text: Column) -> Column:
        return self.embed(F.concat(F.lit(self.query_prefix), text))

    def passages(self, text: Column) -> Column:
        return self.embed(F.concat(F.lit(self.passage_prefix), text))


def tallied(places: Column, dim: int) -> Column:
    """How often each of ``dim`` places occurs in an array, at unit length. The array is bound once, so that its elements
    are computed once and not for each place; so are the counts."""
    count = lambda at: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(at, lambda a: a == i)).cast("double"))
    counts = F.transform(F.array(places), count)
    return F.get(F.transform(counts, normalised), F.lit(0))


def bag_of_words(dim: int = 64, seed: int = 0) -> Embedder:
    """An embedder without a model: words are hashed to places, counted, and the counts brought to unit length."""

    def embed(text: Column) -> Column:
        return tallied(F.transform(X.words(text), lambda w: F.pmod(F.crc32(F.concat(F.lit(f"{seed}:"), w).cast("binary")), F.lit(dim))), dim)

    return Embedder(f"bag-of-words-{dim}", dim, embed)


def retrieve(questions: DataFrame, chunks: DataFrame, embedder: Embedder, k: int) -> DataFrame:
    """``(question_id, chunk_id, score, rank)``: questions (question_id, domain, question) are embedded, the k nearest of their
    domain's chunks (chunk_id, domain, embedding) found."""
    asked = questions.select("question_id", "domain", embedder.queries(F.col("question")).alias("embedding"))
    return top_k(asked, chunks, k, "domain", "question_id", "chunk_id")


def same_dimension(stored: DataFrame, embedder: Embedder) -> None:
    """Stored vectors of another length than the embedder's are an error."""
    wrong = stored.where(F.size("embedding") != embedder.dim).limit(1).count()
    if wrong:
        raise ValueError(f"stored vectors do not have the {embedder.dim} dimensions of {embedder.name}")


# --- evaluation


def sound_questions(scripts: tuple[str, ...] = ("en", "deva", "roman")) -> Column:
    """Whether an evaluation row has gold documents or must be refused, not both, and a known script."""
    return (F.col("must_refuse") != (F.size("gold_doc_ids") > 0)) & F.col("script").isin(*scripts)


def unit(gold: Column, question_id: Column) -> Column:
    """What a bootstrap draws: the topic of the first gold document, its language suffix dropped, or the question itself."""
    return F.when(F.size(gold) > 0, F.regexp_replace(F.get(gold, F.lit(0)), r"-[^-]*$", "")).otherwise(question_id)


def ranks(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """``questions`` with ``first_rank`` (null: none found) and ``best`` score. hits: question_id, doc_id, rank, score."""
    met = questions.select("question_id", "gold_doc_ids").join(hits, "question_id")
    gold = F.array_contains("gold_doc_ids", F.col("doc_id"))
    found = met.groupBy("question_id").agg(F.min(F.when(gold, F.col("rank"))).alias("first_rank"), F.max("score").alias("best"))
    return questions.join(found, "question_id", "left")


def retrieval_by(ranked: DataFrame, by: str) -> DataFrame:
    """``(by, n, recall_1, recall_3, recall_5, mrr)`` of answerable questions by a column and, as 'all', of all."""
    ok = ranked.where("NOT must_refuse")
    at = [F.avg(F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("int")).alias(f"recall_{k}") for k in (1, 3, 5)]
    g = ok.groupingSets([[by], []], by).agg(F.count("*").alias("n"), *at, F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("mrr"))
    return g.select(F.coalesce(by, F.lit("all")).alias(by), "n", "recall_1", "recall_3", "recall_5", "mrr")


def gate(ranked: DataFrame, threshold: float) -> DataFrame:
    """One row (precision, recall, kept) of refusing below a threshold; null without a base."""
    low, due = F.col("best") < threshold, F.col("must_refuse")
    a = ranked.agg(F.count_if(low & due).alias("tp"), F.count_if(low).alias("said"), F.count_if(due).alias("due"), F.count_if(~low & ~due).alias("kept"), F.count_if(~due).alias("ok"))
    return a.select(M.ratio(F.col("tp"), F.col("said")).alias("precision"), M.ratio(F.col("tp"), F.col("due")).alias("recall"), M.ratio(F.col("kept"), F.col("ok")).alias("kept"))


def gate_holds(metrics: Mapping[str, float], baseline: Mapping[str, float]) -> list[str]:
    """The metrics that fell below their baseline."""
    return [k for k, v in baseline.items() if metrics.get(k) is None or metrics[k] < v - 1e-9]


def answer_metrics(questions: DataFrame, answers: DataFrame, drafts: DataFrame, hits: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: refusal precision and recall, how many answerable questions were answered, how many citations stand in
    their chunk, how many answers cite a gold document, the judge's verdicts, and refusals by reason.

    questions: question_id, gold_doc_ids, must_refuse. answers: question_id, refused, refusal_reason, citations. drafts:
    question_id, refused, citations. hits: question_id, chunk_id, text. verdicts: question_id, verdict."""
    cited = drafts.where("NOT refused").select("question_id", F.posexplode("citations").alias("at", "c")).select("question_id", "at", "c.chunk_id", X.collapse(F.col("c.quote")).alias("quote"))
    real = cited.join(hits.select("question_id", "chunk_id", "text"), ["question_id", "chunk_id"], "left")
    real = real.groupBy("question_id").agg(F.count("*").alias("returned"), F.count_if((F.col("quote") != "") & F.contains("text", "quote")).alias("verbatim"))
    j = questions.join(answers.select("question_id", "refused", "refusal_reason", F.transform("citations", lambda c: c["doc_id"]).alias("docs")), "question_id")
    j = j.join(real, "question_id", "left").join(verdicts.select("question_id", "verdict"), "question_id", "left")
    due, said = F.col("must_refuse"), F.col("refused")
    golden = ~said & ~due & F.arrays_overlap("docs", "gold_doc_ids")
    judged = ~said & F.col("verdict").isNotNull()
    counts = j.agg(
        F.count_if(said).alias("refused"), F.count_if(due).alias("due"), F.count_if(said & due).alias("rightly"), F.count_if(~due).alias("ok"), F.count_if(~due & ~said).alias("kept"), F.count_if(~said).alias("answered"),
        F.coalesce(F.sum("returned"), F.lit(0)).alias("citations_returned"), F.coalesce(F.sum("verbatim"), F.lit(0)).alias("verbatim"), F.count_if(golden).alias("golden"), F.count_if(judged).alias("judged"),
        *(F.count_if(judged & (F.col("verdict") == v)).alias(v) for v in ("supported", "partially_supported", "unsupported")), *(F.count_if(F.col("refusal_reason") == r).alias(r) for r in REASONS),
    )
    one = F.lit(1)
    return counts.select(
        M.ratio(F.col("rightly"), F.col("refused")).alias("refusal_precision"), M.ratio(F.col("rightly"), F.col("due")).alias("refusal_recall"),
        (F.col("kept") / F.greatest(one, "ok")).alias("answerable_answered"), "answered", "citations_returned", M.ratio(F.col("verbatim"), F.col("citations_returned")).alias("citation_verbatim"),
        (F.col("golden") / F.greatest(one, "kept")).alias("answers_citing_gold"),
        *(M.ratio(F.col(v), F.col("judged")).alias(f"judge_{n}") for v, n in (("supported", "supported"), ("partially_supported", "partial"), ("unsupported", "unsupported"))), *REASONS,
    )


def agreement(checked: DataFrame, judged: DataFrame, key: str, verdict: str) -> DataFrame:
    """One row (n, agreement) of hand-checked verdicts against a judge's."""
    met = checked.select(key, F.col(verdict).alias("_a")).join(judged.select(key, F.col(verdict).alias("_b")), key)
    return met.agg(F.count("*").alias("n"), F.avg((F.col("_a") == F.col("_b")).cast("int")).alias("agreement"))


# --- caches and the store


def cache_key(model: Column, prompt: Column, question: Column, chunk_ids: Column) -> Column:
    """The address of an output: 16 hex digits over everything that it depends on."""
    return F.left(F.sha2(F.to_json(F.struct(chunk_ids.alias("chunks"), model.alias("model"), prompt.alias("prompt"), question.alias("question"))), 256), F.lit(16))


def looked_up(requests: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """``(hits, misses)`` of requests against a cache with one row a key."""
    return requests.join(cache, key), requests.join(cache.select(key), key, "left_anti")


def pruned(cache: DataFrame, fresh: DataFrame, used: DataFrame, key: str = "key") -> DataFrame:
    """The cache to write: old and fresh rows whose key is used, once each."""
    return cache.unionByName(fresh.join(cache.select(key), key, "left_anti")).join(used.select(key), key, "left_semi")


def upsert(wanted: DataFrame, stored: DataFrame, key: str, content: str, meta: str, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``(store, actions)``: the store after the sync. Unchanged rows stay as they are, rows whose meta alone changed keep
    their vector, rows of new content go through ``embed``, rows that are no longer wanted go."""
    actions = plan(wanted, stored, key, content, meta)
    of = lambda *names: actions.where(F.col("action").isin(*names)).select(key)
    same = stored.join(of("unchanged"), key, "left_semi")
    old = [c for c in stored.columns if c not in wanted.columns]
    changed = wanted.join(of("update"), key, "left_semi").join(stored.select(key, *old), key)
    fresh = embed(wanted.join(of("embed"), key, "left_semi"))
    return same.unionByName(changed.select(stored.columns)).unionByName(fresh.select(stored.columns)), actions


def same_set(one: DataFrame, other: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats included."""
    other = other.select(one.columns)
    return one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def decoded(text: Column, ddl: str) -> Column:
    """A model's JSON output against its schema; null where it does not fit."""
    return F.from_json(text, ddl, {"mode": "PERMISSIVE"})


#: What a model's outputs must look like.
DRAFT = "answer STRING, citations ARRAY<STRUCT<chunk_id: STRING, quote: STRING>>, refused BOOLEAN"
VERDICT = "id STRING, issue STRING, clarification_needed BOOLEAN, issues_mentioned ARRAY<STRING>, language_ok BOOLEAN"
RENDERING = "scenario_id STRING, message STRING, evidence STRING"


def canonical_json(body: Mapping) -> str:
    """A body with its keys in order, as it is hashed."""
    return json.dumps(body, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def canonical_hash(columns: Mapping[str, Column]) -> Column:
    """SHA-256 of the canonical JSON of columns."""
    return F.sha2(F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"}), 256)
