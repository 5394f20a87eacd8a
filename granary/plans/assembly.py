"""Record assembly, usage, presets, answers and the chunk store over stand-ins made of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import assembling as A
from granary.operators import rag as R
from granary.operators import validation as V
from granary.operators.workspace import materialize
from granary.plans.base import query, r6, table
from granary.plans.records import DOMAINS, FAMILY, RECORDS, TAXONOMY, VALID, _case, _listed, records, validated
from granary.plans.serving import SPACES



def _turns(spark, d):
    return table(spark, d, "conversations").withColumn("n", F.col("conv_id") * 1000 + F.col("turn"))


@query(f"""WITH {RECORDS}, f AS (SELECT conv_id, arg_min(text, turn) AS text, arg_min(role, turn) AS role FROM conversations GROUP BY 1)
  SELECT 's' || lpad(CAST(r.doc_id AS VARCHAR), 9, '0') || '-deva' AS record_id, md5(trim(f.text)) AS message_md5, 'short,plain,' || f.role || CASE WHEN family = 'negation' THEN ',negation' ELSE '' END || CASE WHEN f.role = 'user' THEN ',mock' ELSE '' END AS tags,
    CASE WHEN f.role = 'user' THEN 'dry-run' ELSE 'llm' END AS generator, issue FROM r JOIN f ON f.conv_id = r.doc_id""")
def record_assembly(spark, d):
    """Scenarios are the records, renderings the turns of the conversation of the same number; the first turn wins."""
    r = records(spark, d)
    first_role = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.min_by("role", "turn").alias("role"))
    scenario = F.concat(F.lit("s"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    s = r.join(first_role, "doc_id", "left").select(
        scenario.alias("scenario_id"), "scenario_group_id", "domain", "taxonomy_version", F.col("scenario_facts").alias("facts"), "visible_facts", F.array().cast("array<string>").alias("withheld_facts"),
        F.struct(F.lit("short").alias("length"), F.lit("plain").alias("tone"), F.col("role").alias("formality")).alias("style"), F.col("difficulty_family").alias("family"),
        "labels.issue", "labels.issue_target", "labels.clarification_needed", "issues_all", "stated_priority",
    )
    raw = _turns(spark, d).select(
        F.concat(F.lit("s"), F.lpad(F.col("conv_id").cast("string"), 9, "0")).alias("scenario_id"), F.col("text").alias("message"), F.when(F.col("role") == "user", "dry_run").otherwise("hosted").alias("provider"), F.lit("m").alias("model"), F.lit("p1").alias("prompt_version"), "turn"
    )
    made = A.build_records(s, raw, "turn", 7)
    return made.select("record_id", F.md5(F.col("message").cast("binary")).alias("message_md5"), F.array_join("style_tags", ",").alias("tags"), "source.generator", "labels.issue")


@query(f"""WITH {RECORDS}, v AS (SELECT conv_id AS doc_id, turn, role FROM conversations), l AS (SELECT doc_id, arg_max(role, turn) AS role, max(turn) AS turn FROM v GROUP BY 1),
  m AS (SELECT record_id, l.role, CASE WHEN l.turn % 3 = 2 THEN NULL WHEN l.role IS NOT NULL THEN issue IS NOT DISTINCT FROM (CASE WHEN l.turn % 2 = 0 THEN issue ELSE 'other' END) AND asks = (l.turn % 5 <> 0) AND l.role = 'assistant' END AS agrees FROM r LEFT JOIN l USING (doc_id))
  SELECT record_id, agrees, role AS judge FROM m""")
def verdict_fields(spark, d):
    """Verdicts in all three fields: label, clarification and language; every third is a mock."""
    r = records(spark, d)
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role")
    v = t.join(r.select("doc_id", "record_id", "labels"), "doc_id").select(
        "record_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("labels.issue")).otherwise("other").alias("issue"), (F.col("turn") % 5 != 0).alias("clarification_needed"), (F.col("role") == "assistant").alias("language_ok"), F.col("role").alias("model"), (F.col("turn") % 3 == 2).alias("mock")
    )
    return A.merge_verdicts(r, v, "turn").select("record_id", "agrees", "judge")


@query(f"""WITH {VALID}, k AS (SELECT DISTINCT scenario_id FROM va WHERE status = 'accepted' AND origin = 'synthetic') SELECT DISTINCT scenario_id FROM r WHERE scenario_id IN (SELECT scenario_id FROM k)""")
def accepted_scenarios(spark, d):
    r = records(spark, d)
    return A.accepted_scenarios(r.select("scenario_id").distinct(), validated(spark, d), V.origin())


@query("SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) AND conv_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def returned_items(spark, d):
    asked = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("conv_id"))
    done = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("conv_id"))
    return A.returned(table(spark, d, "conversations").select("conv_id", "turn"), asked, done, "conv_id")


PRICES = {"user": [4.0, 20.0, 0.2, 5.0], "assistant": [2.0, 10.0, 0.2, 2.5]}
_USAGE = """u AS (SELECT role, length(text) // 4 AS input_tokens, CASE WHEN turn % 4 <> 3 THEN length(text) // 8 END AS output_tokens, turn * 10 AS cache_read_tokens, 5 AS cache_write_tokens, turn % 2 = 1 AS batch FROM conversations),
  c AS (SELECT *, CASE role WHEN 'user' THEN round((coalesce(input_tokens, 0) * 4.0::DOUBLE + coalesce(output_tokens, 0) * 20.0::DOUBLE + cache_read_tokens * 0.2::DOUBLE + cache_write_tokens * 5.0::DOUBLE) / 1e6 * CASE WHEN batch THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 6)
    WHEN 'assistant' THEN round((coalesce(input_tokens, 0) * 2.0::DOUBLE + coalesce(output_tokens, 0) * 10.0::DOUBLE + cache_read_tokens * 0.2::DOUBLE + cache_write_tokens * 2.5::DOUBLE) / 1e6 * CASE WHEN batch THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 6) END AS usd FROM u)"""


@query(f"WITH {_USAGE} SELECT role, batch, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(cache_write_tokens) AS BIGINT) AS cache_write_tokens, round(sum(usd), 4) AS usd FROM c GROUP BY 1, 2")
def usage_totals(spark, d):
    t = table(spark, d, "conversations")
    log = t.select("role", F.floor(F.length("text") / 4).alias("input_tokens"), F.when(F.col("turn") % 4 != 3, F.floor(F.length("text") / 8)).alias("output_tokens"), (F.col("turn") * 10).alias("cache_read_tokens"), F.lit(5).cast("long").alias("cache_write_tokens"), (F.col("turn") % 2 == 1).alias("batch"))
    prices = spark.createDataFrame(list(PRICES.items()), "role string, prices array<double>")
    priced = log.join(F.broadcast(prices), "role", "left").withColumn("usd", A.cost({c: F.col(c) for c in A.COUNTERS}, F.col("prices"), F.col("batch")))
    return A.usage_totals(priced, ["role", "batch"])


@query("""SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY 1""")
def latency_by_type(spark, d):
    return A.latency(table(spark, d, "events"), "value", ["event_type"]).select("event_type", "n", *(r6(F.col(c)).alias(c) for c in ("p50", "p95", "mean")))


@query(f"WITH {RECORDS} SELECT count(*) AS n, count(issue) AS scored, count_if(issue = {_case(lambda x: f'{_listed(TAXONOMY.categories(x))}[1]')}) AS right, count_if(asks = vague) AS clarification_right, round(avg(length(text)), 6) AS mean_ms FROM r WHERE domain <> 'garage'")
def batch_summary(spark, d):
    r = records(spark, d).where("domain <> 'garage'")
    first = F.coalesce(*(F.when(F.col("domain") == x, F.lit(TAXONOMY.categories(x)[0])) for x in DOMAINS))
    vague = F.col("difficulty_family").isin(*V.UNRESOLVABLE)
    rows = r.select("labels.issue", first.alias("pred"), F.col("labels.clarification_needed").alias("asks"), vague.alias("asked"), F.length("text").alias("ms"))
    return A.batch_summary(rows).select("n", "scored", "right", "clarification_right", r6(F.col("mean_ms")).alias("mean_ms"))


SLOTS = [(f.split(":")[0] if f.startswith("contrast") else f, o) for f in FAMILY for o in ("clean", "translated")]
_FITS = " ".join(f"WHEN (family = '{f}' OR starts_with(family, '{f}:')) AND po = '{o}' THEN {k}" for k, (f, o) in enumerate(SLOTS))


@query(f"""WITH RECURSIVE {RECORDS}, f AS (SELECT domain, record_id, grp, CASE WHEN doc_id % 11 = 1 THEN 'translated' WHEN doc_id % 5 = 0 THEN 'app-review' ELSE 'clean' END AS po, family, message FROM r WHERE length(message) <= 1500),
  g AS (SELECT domain, record_id, grp, CASE {_FITS} END AS slot FROM f), h AS (SELECT * FROM g WHERE slot IS NOT NULL),
  w AS (SELECT domain, -1 AS slot, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS record_id FROM (SELECT DISTINCT domain FROM r)
    UNION ALL SELECT w.domain, w.slot + 1, CASE WHEN p.record_id IS NULL THEN w.used ELSE list_append(w.used, p.grp) END, p.record_id
      FROM w LEFT JOIN LATERAL (SELECT min(h.record_id) AS record_id, arg_min(h.grp, h.record_id) AS grp FROM h WHERE h.domain = w.domain AND h.slot = w.slot + 1 AND NOT list_contains(w.used, h.grp)) p ON true WHERE w.slot < {len(SLOTS) - 1})
  SELECT domain, slot, record_id FROM w WHERE record_id IS NOT NULL""")
def demo_presets(spark, d):
    """A slot is a family and an origin; a group serves one slot of its domain."""
    k = F.col("doc_id")
    generator = F.when(k % 11 == 1, "romanize").otherwise("llm")
    prompt = F.when(k % 5 == 0, "generate_realstyle_v1")
    r = records(spark, d).withColumn("origin", A.preset_origin(generator, prompt))
    return A.presets(r, SLOTS, 1500)


# --- retrieval and answers over the benchmark passages and documents

_BAG = 32


def _store(spark, d):
    """Chunks: documents with a hashed bag-of-words vector; questions: benchmark passages, some of which nothing answers."""
    e = R.bag_of_words(_BAG)
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("t"), F.col("doc_id").cast("string"), F.lit("-en")).alias("doc_id"), (F.col("doc_id") % 2).cast("string").alias("domain"), X.collapse(F.col("text")).alias("text"))
    chunks = docs.withColumn("embedding", e.passages(F.col("text")))
    k = F.col("item_id")
    refuse = k % 8 == 7
    gold = F.when(refuse, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("t"), k.cast("string"), F.lit("-en")), F.concat(F.lit("t"), (k + 2).cast("string"), F.lit("-en"))))
    asked = table(spark, d, "benchmark").select(
        k.cast("string").alias("question_id"), (k % 2).cast("string").alias("domain"), F.col("text").alias("question"), gold.alias("gold_doc_ids"), refuse.alias("must_refuse"), F.when(k % 3 == 0, "en").when(k % 3 == 1, "deva").otherwise("roman").alias("script")
    )
    return e, chunks, asked


def _hits(spark, d, k=5):
    e, chunks, asked = _store(spark, d)
    found = R.retrieve(asked, chunks, e, k)
    return asked, found.join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id")


_VEC = lambda t: f"list_transform(range({_BAG}), lambda i: CAST(len(list_filter({t}, lambda a: a = i)) AS DOUBLE))"


@query(f"""WITH {RECORDS} SELECT record_id, coalesce(issue, '(clarify)') AS label, CASE domain {' '.join(f"WHEN '{x}' THEN [{', '.join(chr(39) + TAXONOMY.question('issue', x, i) + chr(39) for i in range(2))}][doc_id % 2 + 1]" for x in DOMAINS)} END AS asked,
  replace(regexp_replace(substr(message, 1, 20), '<\\|([^|]*)\\|>', '<¦\\1¦>', 'g'), '|', '/') AS shown FROM r""")
def question_wordings(spark, d):
    k = F.col("doc_id")
    r = records(spark, d)
    return r.select("record_id", F.coalesce("labels.issue", F.lit("(clarify)")).alias("label"), TAXONOMY.said("issue", F.col("domain"), k).alias("asked"), F.replace(X.neutralise(F.substr("message", F.lit(1), F.lit(20))), F.lit("|"), F.lit("/")).alias("shown"))


_EVERY = ", ".join(f"('{x}', '{c}', {k}, '{t}')" for x in DOMAINS for k, (c, t) in enumerate(TAXONOMY.criteria(x).items()))


@query(f"""WITH {RECORDS}, t(domain, category, ordinal, description) AS (VALUES {_EVERY}) SELECT record_id, issue, CAST(ordinal AS INT) AS ordinal, description FROM r LEFT JOIN t ON t.domain = r.domain AND t.category = r.issue""")
def taxonomy_lookup(spark, d):
    dimension = F.broadcast(TAXONOMY.table(spark).select("domain", F.col("category").alias("issue"), "ordinal", "description"))
    return records(spark, d).select("record_id", "domain", "labels.issue").join(dimension, ["domain", "issue"], "left").select("record_id", "issue", "ordinal", "description")


@query(f"""WITH {RECORDS} SELECT record_id, md5('<|state|>' || regexp_replace(message, '<\\|([^|]*)\\|>', '<¦\\1¦>', 'g') || '<|q|>' || 'ask' || '<|opt|>no: ' || domain || '<|end|><|opt|>yes<|end|>' || '<|decide|>') AS row_md5, 'run@' || substr(md5(record_id), 1, 7) AS version,
  CASE WHEN issue IS NULL THEN 'n/a' ELSE printf('%.3f', idx / 7.0) END AS shown FROM r""")
def model_rows(spark, d):
    k = F.col("doc_id")
    options = F.array(A.option_text(F.lit("no"), F.col("domain")), A.option_text(F.lit("yes"), F.lit(None).cast("string")))
    at = F.when(F.col("labels.issue").isNotNull(), (F.floor(k / 3) % 4) / 7.0)
    return records(spark, d).select("record_id", F.md5(A.model_row(F.col("message"), F.lit("ask"), options).cast("binary")).alias("row_md5"), A.version(F.lit("run"), F.md5(F.col("record_id").cast("binary"))).alias("version"), A.shown(at).alias("shown"))


_HASHED = lambda col: f"list_transform(regexp_extract_all(lower({col}), '{X.WORD.replace(chr(39), chr(39) * 2)}'), lambda w: ('0x' || substr(md5(w), 1, 4))::BIGINT % 32)"


def _small(spark, d):
    """The same retrieval with an embedder that DuckDB can compute too: words by four hex digits of their MD5."""
    place = lambda w: F.pmod(F.conv(F.substr(F.md5(w.cast("binary")), F.lit(1), F.lit(4)), 16, 10).cast("long"), F.lit(_BAG))

    def embed(text):
        return R.tallied(F.transform(X.words(text), place), _BAG)

    e = R.Embedder("md5", _BAG, embed)
    _, chunks, asked = _store(spark, d)
    chunks = chunks.withColumn("embedding", e.passages(F.col("text")))
    found = R.retrieve(asked, chunks, e, 5).withColumn("score", F.round("score", 9))
    return asked, materialize(found.join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id"), "hits")


_UNIT = "list_transform(v, lambda x: CASE WHEN s > 0 THEN x / s ELSE x END)"
SMALL = f"""ch0 AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, 't' || doc_id || '-en' AS doc_id, CAST(doc_id % 2 AS VARCHAR) AS domain, {SPACES.format('text')} AS text FROM documents),
  ch1 AS (SELECT *, {_HASHED('text')} AS places FROM ch0), ch2 AS (SELECT * EXCLUDE (places), {_VEC('places')} AS v FROM ch1), ch3 AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM ch2), ch AS (SELECT * EXCLUDE (v, s), {_UNIT} AS e FROM ch3),
  qs0 AS (SELECT CAST(item_id AS VARCHAR) AS question_id, CAST(item_id % 2 AS VARCHAR) AS domain, text AS question, CASE WHEN item_id % 8 = 7 THEN [] ELSE ['t' || item_id || '-en', 't' || (item_id + 2) || '-en'] END AS gold, item_id % 8 = 7 AS refuse,
    CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'deva' ELSE 'roman' END AS script FROM benchmark),
  qs1 AS (SELECT *, {_HASHED('question')} AS places FROM qs0), qs2 AS (SELECT * EXCLUDE (places), {_VEC('places')} AS v FROM qs1), qs3 AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM qs2), qs AS (SELECT * EXCLUDE (v, s), {_UNIT} AS e FROM qs3),
  sc AS (SELECT question_id, chunk_id, ch.doc_id, ch.text, list_dot_product(qs.e, ch.e) AS raw FROM qs JOIN ch USING (domain)),
  ht AS (SELECT *, round(raw, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY raw DESC, chunk_id) AS rank FROM sc) WHERE rank <= 5),
  rk AS (SELECT qs.question_id, script, refuse, gold, min(CASE WHEN list_contains(gold, ht.doc_id) THEN rank END) AS first_rank, max(score) AS best FROM qs LEFT JOIN ht USING (question_id) GROUP BY ALL)"""


@query(f"""WITH {SMALL}, x AS (SELECT script FROM rk WHERE false), g AS (SELECT coalesce(script, 'all') AS script, count(*) AS n, {", ".join(f"round(avg(CAST(coalesce(first_rank <= {k}, false) AS INT)), 6) AS recall_{k}" for k in (1, 3, 5))}, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr
  FROM rk WHERE NOT refuse GROUP BY GROUPING SETS ((script), ())) SELECT * FROM g""")
def retrieval_by_script(spark, d):
    asked, hits = _small(spark, d)
    r = R.retrieval_by(R.ranks(asked, hits), "script")
    return r.select("script", "n", *(r6(F.col(c)).alias(c) for c in ("recall_1", "recall_3", "recall_5", "mrr")))


@query(f"WITH {SMALL} SELECT question_id, CASE WHEN len(gold) > 0 THEN regexp_replace(gold[1], '-[^-]*$', '') ELSE question_id END AS unit, (refuse <> (len(gold) > 0)) AS sound FROM qs")
def evaluation_units(spark, d):
    _, _, asked = _store(spark, d)
    return asked.select("question_id", R.unit(F.col("gold_doc_ids"), F.col("question_id")).alias("unit"), R.sound_questions().alias("sound"))


@query(f"""WITH {SMALL}, e AS (SELECT question_id, question, string_agg('<excerpt id="' || chunk_id || '">' || chr(10) || doc_id || chr(10) || chr(10) || text || chr(10) || '</excerpt>', chr(10) ORDER BY rank) AS b FROM ht JOIN qs USING (question_id) GROUP BY 1, 2)
  SELECT question_id, md5('<excerpts>' || chr(10) || b || chr(10) || '</excerpts>' || chr(10) || chr(10) || '<question>' || chr(10) || question || chr(10) || '</question>') AS prompt_md5 FROM e""")
def answer_prompts(spark, d):
    asked, hits = _small(spark, d)
    p = A.excerpts(hits.join(asked.select("question_id", "question"), "question_id").withColumn("title", F.col("doc_id")))
    return p.select("question_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


_METRIC = ("refusal_precision", "refusal_recall", "answerable_answered", "citation_verbatim", "answers_citing_gold", "judge_supported", "judge_partial", "judge_unsupported")


@query(f"""WITH {SMALL}, b AS (SELECT question_id, arg_min(chunk_id, rank) AS chunk_id, arg_min(doc_id, rank) AS doc_id, arg_min(text, rank) AS t, max(score) AS best FROM ht GROUP BY 1),
  dr AS (SELECT question_id, CAST(question_id AS INT) % 9 = 4 AS declined, chunk_id, doc_id, CASE WHEN CAST(question_id AS INT) % 5 = 0 THEN 'nobody wrote this' ELSE trim(substr(t, 1, 30)) END AS quote, t, best FROM b),
  an AS (SELECT *, CASE WHEN best < 0.85 THEN 'low_similarity' WHEN declined THEN 'model_declined' WHEN quote = '' OR NOT contains(t, quote) OR t = '' THEN 'no_valid_citation' END AS reason FROM dr),
  j AS (SELECT an.*, qs.refuse, qs.gold, CASE CAST(question_id AS INT) % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'partially_supported' WHEN 2 THEN 'unsupported' END AS verdict FROM an JOIN qs USING (question_id)),
  c AS (SELECT count_if(reason IS NOT NULL) AS refused, count_if(refuse) AS due, count_if(refuse AND reason IS NOT NULL) AS rightly, count_if(NOT refuse) AS ok, count_if(NOT refuse AND reason IS NULL) AS kept, count_if(reason IS NULL) AS answered, count_if(NOT declined) AS returned,
    count_if(NOT declined AND quote <> '' AND contains(t, quote)) AS verbatim, count_if(reason IS NULL AND NOT refuse AND list_contains(gold, doc_id)) AS golden, count_if(reason IS NULL AND verdict IS NOT NULL) AS judged, count_if(reason IS NULL AND verdict = 'supported') AS s,
    count_if(reason IS NULL AND verdict = 'partially_supported') AS p, count_if(reason IS NULL AND verdict = 'unsupported') AS u, count_if(reason = 'low_similarity') AS low_similarity, count_if(reason = 'model_declined') AS model_declined, count_if(reason = 'no_valid_citation') AS no_valid_citation FROM j)
  SELECT round(CASE WHEN refused > 0 THEN rightly / refused END, 6) AS refusal_precision, round(CASE WHEN due > 0 THEN rightly / due END, 6) AS refusal_recall, round(kept / greatest(1, ok), 6) AS answerable_answered, answered, returned AS citations_returned, round(CASE WHEN returned > 0 THEN verbatim / returned END, 6) AS citation_verbatim,
    round(golden / greatest(1, kept), 6) AS answers_citing_gold, round(CASE WHEN judged > 0 THEN s / judged END, 6) AS judge_supported, round(CASE WHEN judged > 0 THEN p / judged END, 6) AS judge_partial, round(CASE WHEN judged > 0 THEN u / judged END, 6) AS judge_unsupported, low_similarity, model_declined, no_valid_citation FROM c""")
def answer_metrics(spark, d):
    from granary.operators.answering import respond

    asked, hits = _small(spark, d)
    best = hits.groupBy("question_id").agg(F.min_by(F.struct("chunk_id", "text"), "rank").alias("b"))
    n = F.col("question_id").cast("int")
    quote = F.when(n % 5 == 0, "nobody wrote this").otherwise(F.trim(F.substr("b.text", F.lit(1), F.lit(30))))
    drafts = best.select("question_id", (n % 9 == 4).alias("refused"), F.col("b.text").alias("answer"), F.array(F.struct(F.col("b.chunk_id").alias("chunk_id"), quote.alias("quote"))).alias("citations"))
    answers = respond(asked, hits, drafts, 0.85)
    verdicts = asked.select("question_id", F.when(n % 4 == 0, "supported").when(n % 4 == 1, "partially_supported").when(n % 4 == 2, "unsupported").alias("verdict")).where("verdict IS NOT NULL")
    m = R.answer_metrics(asked, answers, drafts, hits, verdicts)
    return m.select(*(r6(F.col(c)).alias(c) for c in _METRIC), "answered", "citations_returned", *R.REASONS)


@query("SELECT count(*) AS n, round(avg(CAST((doc_id % 3 = 0) = (quality = 1) AS INT)), 6) AS agreement FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def judge_agreement(spark, d):
    hand = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "yes").otherwise("no").alias("verdict"))
    judged = table(spark, d, "labels").where("quality IS NOT NULL").select("doc_id", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("verdict"))
    return R.agreement(hand, judged, "doc_id", "verdict").select("n", r6(F.col("agreement")).alias("agreement"))


_STORED = """st0 AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN md5(text || 'x') ELSE md5(text) END AS h, CASE WHEN doc_id % 10 = 2 THEN 'xx' ELSE lang END AS m, doc_id AS vector FROM documents WHERE doc_id % 10 <> 0),
  wt AS (SELECT doc_id, md5(text) AS h, lang AS m FROM documents WHERE doc_id % 10 <> 9)"""


@query(f"WITH {_STORED} SELECT wt.doc_id, wt.h, wt.m, CASE WHEN st0.h = wt.h THEN st0.vector ELSE -wt.doc_id END AS vector FROM wt LEFT JOIN st0 USING (doc_id)")
def kb_upsert(spark, d):
    """The store after a sync: vectors of unchanged content stay, others are made anew (here: the negative id)."""
    t, k = table(spark, d, "documents"), F.col("doc_id") % 10
    wanted = t.where(k != 9).select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), F.col("lang").alias("m"))
    stored = t.where(k != 0).select("doc_id", F.md5(F.concat("text", F.when(k == 1, "x").otherwise("")).cast("binary")).alias("h"), F.when(k == 2, "xx").otherwise(F.col("lang")).alias("m"), F.col("doc_id").alias("vector"))
    return R.upsert(wanted, stored, "doc_id", "h", "m", lambda new: new.withColumn("vector", -F.col("doc_id")))[0]


@query("""WITH q AS (SELECT doc_id, substr(sha256('{"chunks":["c' || doc_id % 7 || '"],"model":"m","prompt":"p","question":"' || lang || '"}'), 1, 16) AS key FROM documents), c AS (SELECT DISTINCT key FROM q WHERE doc_id % 3 = 0)
  SELECT doc_id, key, key IN (SELECT key FROM c) AS cached FROM q""")
def answer_cache(spark, d):
    """Outputs addressed by all that they depend on: what is in the cache, and what must be asked."""
    k = F.col("doc_id")
    q = table(spark, d, "documents").select("doc_id", R.cache_key(F.lit("m"), F.lit("p"), F.col("lang"), F.array(F.concat(F.lit("c"), (k % 7).cast("string")))).alias("key"))
    hits, misses = R.looked_up(q, q.where(k % 3 == 0).select("key").distinct())
    return hits.select("doc_id", "key", F.lit(True).alias("cached")).union(misses.select("doc_id", "key", F.lit(False)))


@query("""WITH e AS (SELECT event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS body_hash FROM events) SELECT event_id, body_hash FROM e""")
def body_hashes(spark, d):
    return table(spark, d, "events").select("event_id", R.canonical_hash({"user_id": F.col("user_id"), "event_type": F.col("event_type")}).alias("body_hash"))


