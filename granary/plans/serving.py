"""Retrieval, grounding, request logs, idempotent ingestion and work queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import metrics as M
from granary.operators.logs import by_intent, ingest, window_stats
from granary.operators.records import batches, latest, pending
from granary.operators.retrieval import auc as area
from granary.operators.retrieval import top_k
from granary.operators.workspace import materialize
from granary.plans.base import CUES, PRED, SQL, predictions, query, r6, table

NOW = "2024-01-31 00:00:00"
TOP = """q AS (SELECT vec_id AS query_id, embedding AS e, label, label % 3 AS dom FROM embeddings WHERE vec_id % 10 = 0), k AS (SELECT vec_id AS item_id, embedding AS e, label AS item_label, label % 3 AS dom FROM embeddings WHERE vec_id % 10 <> 0 AND label <> 9),
  sc AS (SELECT query_id, item_id, label, item_label, list_dot_product(CAST(q.e AS DOUBLE[]), CAST(k.e AS DOUBLE[])) AS score FROM q JOIN k USING (dom)),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM sc) WHERE rank <= 10),
  fr AS (SELECT q.query_id, q.label = 9 AS refuse, min(CASE WHEN top.item_label = q.label THEN rank END) AS first_rank, max(score) AS best FROM q LEFT JOIN top USING (query_id) GROUP BY 1, 2)"""


def _top(spark, d):
    e = table(spark, d, "embeddings").withColumn("dom", F.col("label") % 3)
    q = e.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    k = e.where("vec_id % 10 <> 0 AND label <> 9").withColumnRenamed("vec_id", "item_id")
    return q, k, top_k(q, k, 10, "dom", digits=9)


def _ranked(spark, d):
    q, k, top = _top(spark, d)
    hits = top.join(k.select("item_id", F.col("label").alias("item_label")), "item_id")
    j = q.select("query_id", "label").join(hits, "query_id", "left")
    return j.groupBy("query_id", (F.col("label") == 9).alias("refuse")).agg(F.min(F.when(F.col("item_label") == F.col("label"), F.col("rank"))).alias("first_rank"), F.max("score").alias("best"))


@query(f"WITH {TOP} SELECT query_id, CAST(rank AS BIGINT) AS rank, item_id, round(score, 6) AS score FROM top")
def vector_topk(spark, d):
    return _top(spark, d)[2].select("query_id", F.col("rank").cast("long").alias("rank"), "item_id", r6(F.col("score")).alias("score"))


@query(f"WITH {TOP} SELECT query_id, CAST(first_rank AS BIGINT) AS first_rank FROM fr")
def first_gold_rank(spark, d):
    return _ranked(spark, d).select("query_id", F.col("first_rank").cast("long").alias("first_rank"))


RECALL = ", ".join(f"round(avg(CAST(coalesce(first_rank <= {k}, false) AS INT)), 6) AS recall_{k}" for k in (1, 3, 5))


@query(f"WITH {TOP} SELECT count(*) AS n, {RECALL}, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr FROM fr WHERE NOT refuse")
def retrieval_metrics(spark, d):
    r = _ranked(spark, d).where("NOT refuse")
    at = [r6(F.avg(F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("int"))).alias(f"recall_{k}") for k in (1, 3, 5)]
    return r.agg(F.count("*").alias("n"), *at, r6(F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))).alias("mrr"))


@query(f"""WITH {TOP}, a AS (SELECT count_if(best < 0.3 AND refuse) AS tp, count_if(best < 0.3) AS said, count_if(refuse) AS due, count_if(NOT refuse AND best >= 0.3) AS kept, count_if(NOT refuse) AS ok FROM fr)
  SELECT round(CASE WHEN said > 0 THEN tp / said END, 6) AS precision, round(CASE WHEN due > 0 THEN tp / due END, 6) AS recall, round(CASE WHEN ok > 0 THEN kept / ok END, 6) AS kept FROM a""")
def refusal_gate(spark, d):
    low = F.col("best") < 0.3
    a = _ranked(spark, d).agg(F.count_if(low & F.col("refuse")).alias("tp"), F.count_if(low).alias("said"), F.count_if("refuse").alias("due"), F.count_if(~F.col("refuse") & (F.col("best") >= 0.3)).alias("k"), F.count_if(~F.col("refuse")).alias("ok"))
    return a.select(r6(M.ratio(F.col("tp"), F.col("said"))).alias("precision"), r6(M.ratio(F.col("tp"), F.col("due"))).alias("recall"), r6(M.ratio(F.col("k"), F.col("ok"))).alias("kept"))


@query(f"""WITH {TOP}, r AS (SELECT round(best, 9) AS best, refuse FROM fr WHERE best IS NOT NULL) SELECT round(sum(CASE WHEN p.best > n.best THEN 1.0 WHEN p.best = n.best THEN 0.5 ELSE 0 END) / nullif(count(*), 0), 6) AS auc FROM r p JOIN r n ON NOT p.refuse AND n.refuse""")
def auc(spark, d):
    r = _ranked(spark, d).where("best IS NOT NULL").select(F.round("best", 9).alias("best"), (~F.col("refuse")).alias("answerable"))
    return area(r, "best", "answerable").select(r6(F.col("auc")).alias("auc"))


SQL_THRESHOLD = f"""WITH {TOP}, r AS (SELECT round(best, 9) AS s, refuse FROM fr WHERE best IS NOT NULL), u AS (SELECT DISTINCT s FROM r),
  l AS (SELECT s, lag(s) OVER (ORDER BY s) AS below FROM u), c AS (SELECT CASE WHEN below IS NULL THEN s - 0.001 ELSE (below + s) / 2 END AS t, s - coalesce(below, s - 0.001) AS gap FROM l),
  e AS (SELECT t, max(gap) AS gap, count_if(NOT refuse AND s >= t) / nullif(count_if(NOT refuse), 0) AS kept, count_if(refuse AND s < t) / nullif(count_if(refuse), 0) AS refused FROM c, r GROUP BY t)
  SELECT round(t, 6) AS threshold, round(kept, 6) AS kept, round(refused, 6) AS refused FROM e WHERE kept >= 0.9 ORDER BY refused DESC, round(gap, 9) DESC, t DESC LIMIT 1"""


@query(SQL_THRESHOLD)
def threshold_search(spark, d):
    from granary.operators.thresholds import best_threshold

    r = _ranked(spark, d).where("best IS NOT NULL").select(F.round("best", 9).alias("s"), "refuse")
    return best_threshold(r, "s", "refuse", 0.9).select(*(r6(F.col(c)).alias(c) for c in ("threshold", "kept", "refused")))


SPACES = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query(f"""WITH q AS (SELECT item_id, {SPACES.format('text')} AS t FROM benchmark), s AS (SELECT doc_id, {SPACES.format('text')} AS t FROM documents)
  SELECT item_id, doc_id FROM q JOIN s ON contains(s.t, q.t) WHERE q.t <> ''""")
def citation_grounding(spark, d):
    from granary.operators.grounding import verbatim

    return verbatim(table(spark, d, "benchmark"), "item_id", table(spark, d, "documents"), "doc_id")


SQL_EVENTS = f"e AS (SELECT *, CASE user_id % 3 WHEN 0 THEN 'shop' WHEN 1 THEN 'wallet' ELSE 'bank' END AS channel FROM events), w AS (SELECT * FROM e WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 240 HOUR AND ts <= TIMESTAMP '{NOW}')"


def _events(spark, d):
    e = table(spark, d, "events")
    channel = F.when(F.col("user_id") % 3 == 0, "shop").when(F.col("user_id") % 3 == 1, "wallet").otherwise("bank")
    return e.withColumn("channel", channel)


@query(f"WITH {SQL_EVENTS} SELECT count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(CAST(event_type = 'error' AS INT)), 6) AS clarification_rate FROM w")
def stats_window(spark, d):
    return window_stats(_events(spark, d), NOW, 240, "ts", "value", F.col("event_type") == "error")


@query(f"WITH {SQL_EVENTS} SELECT channel, event_type AS intent, count(*) AS n FROM w GROUP BY 1, 2")
def stats_by_intent(spark, d):
    return by_intent(_events(spark, d), NOW, 240, "ts", "channel", "event_type")


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_stats(spark, d):
    from granary.streaming.logs import daily_stats

    return daily_stats(spark, d)


@query("""WITH e AS (SELECT event_id, user_id || ':' || props AS k, sha256(event_type) AS body, row_number() OVER (PARTITION BY user_id || ':' || props ORDER BY ts, event_id) AS rn, first_value(sha256(event_type)) OVER (PARTITION BY user_id || ':' || props ORDER BY ts, event_id) AS b0 FROM events)
  SELECT event_id, CASE WHEN rn = 1 THEN 'stored' WHEN body = b0 THEN 'replay' ELSE 'conflict' END AS outcome FROM e""")
def idempotent_ingest(spark, d):
    e = table(spark, d, "events").withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "props"))
    return ingest(e, "key", F.sha2("event_type", 256), ["ts", "event_id"]).select("event_id", "outcome")


@query("""SELECT c.conv_id, c.turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.conv_id)""")
def pending_work(spark, d):
    return pending(table(spark, d, "conversations"), table(spark, d, "labels").select(F.col("doc_id").alias("conv_id")), ["conv_id"]).select("conv_id", "turn")


@query("""SELECT conv_id, turn, role, CAST(floor((row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1) / 20) AS BIGINT) AS batch FROM conversations""")
def request_batches(spark, d):
    return batches(table(spark, d, "conversations"), ["role"], ["conv_id", "turn"], 20).select("conv_id", "turn", "role", "batch")


@query("""WITH t AS (SELECT role, length(text) // 4 AS tokens FROM conversations), p AS (SELECT * FROM (VALUES ('user', 4.0), ('assistant', 20.0)) v(role, usd))
  SELECT t.role, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, round(CAST(sum(tokens) * max(p.usd) / 1e6 * 0.5 AS DOUBLE), 6) AS cost FROM t LEFT JOIN p USING (role) GROUP BY 1""")
def usage_cost(spark, d):
    t = table(spark, d, "conversations").select("role", F.floor(F.length("text") / 4).alias("tokens"))
    price = spark.createDataFrame([("user", 4.0), ("assistant", 20.0)], "role string, usd double")
    sums = t.groupBy("role").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
    return sums.join(F.broadcast(price), "role", "left").select("role", "requests", "tokens", r6(F.col("tokens") * F.col("usd") / 1e6 * 0.5).alias("cost"))


@query("""WITH v AS (SELECT conv_id AS doc_id, role AS verdict, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
  SELECT d.doc_id, verdict, verdict IS NOT NULL AND verdict = CASE WHEN lang = 'en' THEN 'user' ELSE 'assistant' END AS agrees FROM documents d LEFT JOIN (SELECT * FROM v WHERE rn = 1) v USING (doc_id)""")
def verdict_merge(spark, d):
    v = latest(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("verdict"), "turn"), ["doc_id"], ["turn"])
    j = table(spark, d, "documents").join(v, "doc_id", "left")
    return j.select("doc_id", "verdict", F.col("verdict").eqNullSafe(F.when(F.col("lang") == "en", "user").otherwise("assistant")).alias("agrees"))


SENTENCE = r"CASE WHEN regexp_extract(c, '^(.*?[.!?।])(?:\s|$)', 1) = '' THEN c ELSE regexp_extract(c, '^(.*?[.!?।])(?:\s|$)', 1) END"


@query(rf"""WITH {TOP}, h AS (SELECT query_id, item_id, score, coalesce({SPACES.format('text')}, '') AS c FROM top LEFT JOIN documents ON doc_id = item_id WHERE rank <= 5),
  b AS (SELECT query_id, arg_min(c, {{'s': -round(score, 6), 'i': CAST(item_id AS VARCHAR)}}) AS c, arg_min(item_id, {{'s': -round(score, 6), 'i': CAST(item_id AS VARCHAR)}}) AS item_id, max(round(score, 6)) AS best FROM h GROUP BY 1),
  a AS (SELECT q.query_id, best, item_id, {SENTENCE} AS quote, CASE WHEN query_id % 30 = 0 THEN 'no text has this' ELSE {SENTENCE} END AS cited, c, query_id % 40 = 0 AS declined FROM q LEFT JOIN b USING (query_id)),
  r AS (SELECT *, CASE WHEN best IS NULL OR best < 0.3 THEN 'low_similarity' WHEN declined THEN 'model_declined' WHEN quote = '' OR NOT contains(c, cited) THEN 'no_valid_citation' END AS reason FROM a)
  SELECT query_id, reason IS NOT NULL AS refused, reason AS refusal_reason, CASE WHEN reason IS NULL THEN md5(quote) END AS answer_md5, CASE WHEN reason IS NULL THEN CAST(item_id AS VARCHAR) END AS cited FROM r""")
def answer_pipeline(spark, d):
    from granary.functions.text import collapse
    from granary.operators.answering import extractive, respond

    q, _, top = _top(spark, d)
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    hits = top.where("rank <= 5").join(texts, "item_id", "left").select("query_id", F.col("item_id").cast("string").alias("chunk_id"), F.col("item_id").cast("string").alias("doc_id"), collapse(F.coalesce("text", F.lit(""))).alias("text"), r6(F.col("score")).alias("score"))
    hits = materialize(hits.withColumnRenamed("query_id", "question_id"), "hits")  # they are read four times
    drafts = extractive(hits)
    forged = F.transform("citations", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), F.when(F.col("question_id") % 30 == 0, "no text has this").otherwise(c["quote"]).alias("quote")))
    drafts = drafts.select("question_id", (F.col("question_id") % 40 == 0).alias("refused"), "answer", forged.alias("citations"))
    asked = q.select(F.col("query_id").alias("question_id"), F.lit("How?").alias("question"))
    r = respond(asked, hits, drafts, 0.3)
    answered = lambda c: F.when(~F.col("refused"), c)
    return r.select(F.col("question_id").alias("query_id"), "refused", "refusal_reason", answered(F.md5(F.col("answer").cast("binary"))).alias("answer_md5"), answered(F.get("citations", F.lit(0))["chunk_id"]).alias("cited"))


RANKED = "list_transform(list_sort([" + ", ".join(f"{{'p': -p_{c}, 'i': {i}, 'c': '{c}'}}" for i, c in enumerate(CUES)) + "]), lambda x: x.c)"


@query(f"""WITH {PRED}, d AS (SELECT doc_id, CASE WHEN clar >= 0.9 THEN 'unclear_message' WHEN conf < 0.6 THEN 'low_confidence' END AS reason, list_filter({RANKED}, lambda c: c <> 'other')[1:2] AS two,
    CASE WHEN clar >= 0.9 THEN 'clarify' WHEN conf >= 0.6 THEN 'route' ELSE 'triage' END AS action FROM pred)
  SELECT doc_id, reason IS NOT NULL AS needs_clarification, reason, CASE WHEN reason = 'low_confidence' THEN array_to_string(two, ',') END AS options, action FROM d""")
def clarification_decisions(spark, d):
    from granary.operators.answering import act, decide

    made = predictions(spark, d).select("doc_id", decide(F.col("clar"), F.col("conf"), F.col("p"), list(CUES), "other", 0.9, 0.6).alias("x"), act(F.col("clar"), F.col("conf"), 0.9, 0.6).alias("action"))
    return made.select("doc_id", "x.needs_clarification", "x.reason", F.array_join("x.options", ",").alias("options"), "action")


@query(SQL["idempotent_ingest"])
def stream_ingest(spark, d):
    """The same rows as they arrive in a stream."""
    from granary.streaming.ingest import ingest_stream
    from granary.streaming.logs import read_events

    e = read_events(spark, d).withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "props"))
    return ingest_stream(e, "key", F.sha2("event_type", 256), ["ts", "event_id"]).select("event_id", "outcome")
