"""Records, their validation and their mix. The given tables hold no records, so each document is turned into one: its
fields follow from its id, its message is a phrase and the whole text."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import validation as V
from granary.operators.mixing import build_splits as mix
from granary.operators.mixing import label_shares, leaks, share_range, split_summary
from granary.operators.splits import sql_assign
from granary.plans.base import SQL_GROUP, SQL_NORM, group_of, query, sql_uniform, table
from granary.plans.corpus import NEAR
from granary.sources.configs import taxonomy

FAMILY = ["single", "contrast:a", "negation", "corrected_statement", "irrelevant_background", "missing_details", "out_of_scope", "vague", "multi_issue:no_priority", "multi_issue:stated_priority"]
PHRASES = ["मेरो अर्डर आएन। ", "mero paisa aaena. ", "mera paisa nahi aaya hai kya. ", "", "payment_failed, money has not come: ", "mero order kahile aaucha, paisa katiyo tara ", "मेरो बैंक खाता खुल्दैन "]
CATEGORIES = {
    "shop": {"order_late": "An order is past its date", "wrong_item": "Something else was delivered", "refund_pending_long": "A refund takes too long", "other": "Anything else"},
    "wallet": {"payment_failed": "Money has not come!", "sent_to_wrong_person": "A transfer went to someone else", "login": "The customer cannot sign in", "other": "Anything else"},
    "bank": {"card_blocked": "A card does not work", "transfer_not_received_yet": "A transfer is missing", "loan": "A question about a loan", "other": "Anything else"},
}
TAXONOMY = taxonomy(
    {
        "version": "t-1",
        "fallback": "other",
        "questions": {
            "issue": {"instructions": ["Which problem does this {domain} message tell of?", "Sort this {domain} message."]},
            "clarification": {"instructions": ["Is this {domain} message unclear?"], "criteria": {"true": "It is unclear", "false": "It is clear"}},
        },
        "domains": {d: {"name": f"the {d}", "categories": {c: {"description": t} for c, t in cs.items()}} for d, cs in CATEGORIES.items()},
    }
)
DOMAINS = list(CATEGORIES)


def _pick(values, index):
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def records(spark, d):
    """One record a document, in the engine's record shape, with the verdicts on it and ``doc_id`` as its order."""
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    k = F.col("doc_id")
    at = F.floor(k / 3) % 4
    domain = F.when(k % 41 == 0, "garage").otherwise(_pick(DOMAINS, k % 3))
    names = lambda i: F.coalesce(*(F.when(domain == x, _pick(list(c), i)) for x, c in CATEGORIES.items()), _pick(list(CATEGORIES["shop"]), i))
    family = _pick(FAMILY, k % 10)
    vague = family.isin(*V.UNRESOLVABLE)
    issue = F.when(vague != (k % 13 == 0), None).when(k % 29 == 0, "bogus").otherwise(names(at))
    soft = F.create_map(F.when(k % 31 == 0, "bogus").otherwise(names(F.lit(0))), F.lit(0.5), names(F.lit(1)), F.lit(0.5))
    amount = (k % 900 + 100).cast("string")
    none = F.array().cast("array<string>")
    many = lambda *pairs: F.concat(*(F.when(c, F.array(v)).otherwise(none) for c, v in pairs))
    return t.select(
        "doc_id", "lang", "text", "quality",
        F.concat(F.lit("r"), F.lpad(k.cast("string"), 9, "0")).alias("record_id"),
        F.concat(F.lit("s"), F.lpad(F.floor(k / 2).cast("string"), 9, "0")).alias("scenario_id"),
        group_of(k).alias("scenario_group_id"), domain.alias("domain"),
        F.when(k % 37 == 0, "t-0").otherwise("t-1").alias("taxonomy_version"),
        F.create_map(F.lit("amount_npr"), amount).alias("scenario_facts"),
        many((k % 4 == 0, F.lit("amount_npr"))).alias("visible_facts"),
        F.concat(_pick(PHRASES, k % 7), F.when(k % 8 < 4, F.concat(F.lit("rs "), amount, F.lit(" "))).otherwise(""), "text").alias("message"),
        F.when(k % 11 == 0, None).when((k % 7).isin(0, 6), "deva").otherwise("roman").alias("script"),
        many((k % 5 == 0, F.lit("realstyle")), (k % 6 == 0, F.lit("negation"))).alias("style_tags"),
        family.alias("difficulty_family"),
        F.struct(issue.alias("issue"), F.when(issue.isNull(), soft).alias("issue_target"), (vague != (k % 17 == 0)).alias("clarification_needed")).alias("labels"),
        F.when(issue.isNull(), none).otherwise(many((F.lit(True), issue), (k % 19 == 0, F.lit("staff")), (k % 10 == 9, names((at + 1) % 4)))).alias("issues_all"),
        F.when((k % 10 == 9) & (k % 23 != 0), issue).alias("stated_priority"),
        F.struct(F.when(k % 11 == 0, "external").otherwise("llm").alias("generator")).alias("source"),
        F.when(k % 11 == 1, F.struct(F.lit("r").alias("parent_record_id"))).alias("derivation"),
        (F.col("quality") != 0).alias("verifier_agrees"),
        F.when((F.col("quality") == 0) & (k % 3 != 0), k % 2 == 0).alias("adjudicator_agrees"),
        X.content_hash(F.col("text")).alias("content_hash"),
    )


def _listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _case(make, otherwise: str = "NULL") -> str:
    return "CASE domain " + " ".join(f"WHEN '{d}' THEN {make(d)}" for d in DOMAINS) + f" ELSE {otherwise} END"


def _names(i: str) -> str:
    return _case(lambda d: f"{_listed(CATEGORIES[d])}[{i} + 1]", f"{_listed(CATEGORIES['shop'])}[{i} + 1]")


SQL_ORIGIN = "CASE WHEN doc_id % 11 = 0 THEN 'external' WHEN doc_id % 11 = 1 THEN 'translated' WHEN doc_id % 5 = 0 THEN 'realstyle' ELSE 'synthetic' END"
RECORDS = f"""r0 AS (SELECT d.doc_id, lang, text, quality, {SQL_GROUP} AS grp, CASE WHEN doc_id % 41 = 0 THEN 'garage' ELSE {_listed(DOMAINS)}[doc_id % 3 + 1] END AS domain,
    (doc_id // 3) % 4 AS idx, {_listed(FAMILY)}[doc_id % 10 + 1] AS family, doc_id % 10 IN (7, 8) AS vague, doc_id % 900 + 100 AS amount FROM documents d LEFT JOIN labels l USING (doc_id)),
  r1 AS (SELECT *, CASE WHEN vague <> (doc_id % 13 = 0) THEN NULL WHEN doc_id % 29 = 0 THEN 'bogus' ELSE {_names("idx")} END AS issue,
    {_listed(PHRASES)}[doc_id % 7 + 1] || CASE WHEN doc_id % 8 < 4 THEN 'rs ' || amount || ' ' ELSE '' END || text AS message,
    CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 IN (0, 6) THEN 'deva' ELSE 'roman' END AS script, vague <> (doc_id % 17 = 0) AS asks,
    'r' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS record_id, 's' || lpad(CAST(doc_id // 2 AS VARCHAR), 9, '0') AS scenario_id, {SQL_ORIGIN} AS origin FROM r0),
  r AS (SELECT *, CASE WHEN issue IS NULL THEN [] ELSE [issue] || CASE WHEN doc_id % 19 = 0 THEN ['staff'] ELSE [] END || CASE WHEN doc_id % 10 = 9 THEN [{_names('((idx + 1) % 4)')}] ELSE [] END END AS issues,
    CASE WHEN doc_id % 10 = 9 AND doc_id % 23 <> 0 THEN issue END AS priority, CASE WHEN quality IS NOT NULL THEN quality <> 0 END AS verifier,
    CASE WHEN quality = 0 AND doc_id % 3 <> 0 THEN doc_id % 2 = 0 END AS adjudicator FROM r1)"""
_LOW = "translate(lower(message), '०१२३४५६७८९', '0123456789')"
_AMOUNTS = (
    f"list_transform(regexp_extract_all({_LOW}, '{X.AMOUNT}'), lambda x: round(CAST(replace(x, ',', '') AS DOUBLE), 2)) || "
    f"list_transform(regexp_extract_all({_LOW}, '{X.THOUSANDS}', 1), lambda x: round(round(CAST(x AS DOUBLE), 2) * 1000, 2)) || "
    f"list_transform(regexp_extract_all({_LOW}, '{X.LAKHS}', 1), lambda x: round(round(CAST(x AS DOUBLE), 2) * 100000, 2))"
)


def _count(lexicon, ending: str | None = None) -> str:
    test = f"list_contains({_listed(lexicon)}, w)" + (f" OR regexp_matches(w, '^{ending}')" if ending else "")
    return f"len(list_filter(ws, lambda w: {test}))"


_NEGATED = f"len(list_filter(ws, lambda w: list_contains({_listed(X.NEGATIONS)}, w) OR regexp_matches(w, '{X.NEGATION_DEVA}') OR regexp_matches(w, '{X.NEGATION_ROMAN}'))) > 0"


def _leaks(d: str) -> str:
    tests = [f"contains(lower(message), '{c}')" for c in CATEGORIES[d] if "_" in c]
    tests += [f"contains(nm, '{c.replace('_', ' ')}')" for c in CATEGORIES[d] if c.count("_") >= 2]
    tests += [f"contains(nm, '{X.normal(t)}')" for t in CATEGORIES[d].values()]
    return "(" + " OR ".join(tests) + ")"


_WORDS = X.WORD.replace("'", "''")
_BROKEN = [
    ("too_short", f"length(message) < {V.SHORTEST}"),
    ("too_long", f"length(message) > {V.LONGEST}"),
    ("script_mismatch", "found IS DISTINCT FROM script AND NOT coalesce(doc_id % 5 = 0 AND script = 'deva' AND found = 'mixed', false)"),
    ("not_nepali", "ne = 0"),
    ("hindi_not_nepali", "ne > 0 AND hi > ne"),
    ("unknown_label", "(issue IS NOT NULL AND NOT list_contains(known, issue)) OR (issue IS NULL AND doc_id % 31 = 0) OR (len(list_filter(issues, lambda x: NOT list_contains(known, x))) > 0 AND issue IS DISTINCT FROM 'other')"),
    ("label_family_mismatch", "vague <> asks OR vague = (issue IS NOT NULL) OR (doc_id % 10 = 9 AND (priority IS DISTINCT FROM issue OR len(issues) < 2))"),
    ("missing_evidence", f"doc_id % 4 = 0 AND NOT list_contains({_AMOUNTS}, CAST(amount AS DOUBLE))"),
    ("missing_negation", f"(doc_id % 6 = 0 OR doc_id % 10 = 2) AND NOT ({_NEGATED})"),
    ("label_leakage", _case(_leaks)),
]
_NORM_MESSAGE = SQL_NORM.replace("(text)", "(message)")
CHECKED = f"""{RECORDS}, w0 AS (SELECT *, regexp_extract_all(lower(message), '{_WORDS}') AS ws, {_NORM_MESSAGE} AS nm, {_case(lambda d: _listed(CATEGORIES[d]))} AS known,
    CASE WHEN regexp_matches(message, '[ऀ-ॣॱ-ॿ]') AND regexp_matches(message, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(message, '[ऀ-ॣॱ-ॿ]') THEN 'deva' ELSE 'roman' END AS found FROM r),
  w AS (SELECT *, CASE WHEN script = 'deva' THEN {_count(X.NEPALI_DEVA, X.NEPALI_DEVA_END)} ELSE {_count(X.NEPALI_ROMAN, X.NEPALI_ROMAN_END)} END AS ne,
    CASE WHEN script = 'deva' THEN {_count(X.HINDI_DEVA)} ELSE {_count(X.HINDI_ROMAN)} END AS hi FROM w0),
  ck AS (SELECT *, CASE WHEN doc_id % 37 = 0 THEN ['taxonomy_version'] WHEN domain = 'garage' THEN ['unknown_domain'] ELSE list_filter([{", ".join(f"CASE WHEN {b} THEN '{n}' END" for n, b in _BROKEN)}], lambda x: x IS NOT NULL) END AS findings FROM w),
  st AS (SELECT *, CASE WHEN len(findings) > 0 OR (NOT coalesce(verifier, true) AND NOT coalesce(adjudicator, true)) THEN 'rejected' WHEN NOT coalesce(verifier, true) AND adjudicator IS NULL THEN 'queued' ELSE 'accepted' END AS s0,
    CASE WHEN len(findings) > 0 THEN findings[1] WHEN NOT coalesce(verifier, true) AND NOT coalesce(adjudicator, true) THEN 'label_disputed' END AS why0 FROM ck),
  lv AS (SELECT doc_id, grp, nm AS t FROM st WHERE s0 <> 'rejected'), f0 AS (SELECT t, min(doc_id) AS d0, arg_min(grp, doc_id) AS g0 FROM lv GROUP BY t),
  eq AS (SELECT doc_id, d0 FROM lv JOIN f0 USING (t) WHERE d0 < doc_id AND g0 <> grp)"""
_TAIL = NEAR[NEAR.index("dt AS (") :]
VALID = f"""{CHECKED}, n AS (SELECT doc_id, grp, t FROM lv WHERE doc_id NOT IN (SELECT doc_id FROM eq)), {_TAIL}, nr AS (SELECT b AS doc_id, min(a) AS d0 FROM pairs GROUP BY b),
  va AS (SELECT st.*, CASE WHEN eq.doc_id IS NOT NULL OR nr.doc_id IS NOT NULL THEN 'rejected' ELSE s0 END AS status, CASE WHEN eq.doc_id IS NOT NULL THEN 'exact_duplicate' WHEN nr.doc_id IS NOT NULL THEN 'near_duplicate' ELSE why0 END AS reason,
    coalesce(eq.d0, nr.d0) AS duplicate_of FROM st LEFT JOIN eq ON eq.doc_id = st.doc_id LEFT JOIN nr ON nr.doc_id = st.doc_id)"""


def validated(spark, d):
    return V.validate(records(spark, d), TAXONOMY, "doc_id")


@query(f"WITH {VALID} SELECT record_id, array_to_string(findings, ',') AS findings, status, reason, duplicate_of FROM va")
def validate_records(spark, d):
    return validated(spark, d).select("record_id", F.array_join("findings", ",").alias("findings"), "status", "reason", "duplicate_of")


@query(f"""WITH {VALID}, e AS (SELECT 'status' AS section, NULL AS domain, status AS key FROM va UNION ALL SELECT 'reason', NULL, reason FROM va WHERE status = 'rejected'
  UNION ALL SELECT 'issue', domain, coalesce(issue, '(clarify)') FROM va WHERE status = 'accepted' UNION ALL SELECT 'script', NULL, script FROM va WHERE status = 'accepted'
  UNION ALL SELECT 'family', NULL, split_part(family, ':', 1) FROM va WHERE status = 'accepted') SELECT section, domain, key, count(*) AS n FROM e GROUP BY ALL""")
def validation_report(spark, d):
    return V.report(validated(spark, d))


_EVERY = ", ".join(f"('{d}', '{c}')" for d, cs in CATEGORIES.items() for c in cs)


@query(f"""WITH {VALID}, a AS (SELECT domain, issue AS category, count(*) AS n FROM va WHERE status = 'accepted' GROUP BY 1, 2), t AS (SELECT domain, sum(n) AS total FROM a GROUP BY 1),
  k(domain, category) AS (VALUES {_EVERY}) SELECT domain, category, coalesce(n, 0) AS n, CAST(total AS BIGINT) AS total FROM t JOIN k USING (domain) LEFT JOIN a USING (domain, category) WHERE total >= 5 AND coalesce(n, 0) < 0.05 * total""")
def validation_warnings(spark, d):
    return V.warnings(validated(spark, d), TAXONOMY, enough=5)


@query(f"""WITH {RECORDS} SELECT record_id, origin, (doc_id % 11 = 0) = (script IS NULL) AND length(message) > 0 AS sound FROM r""")
def record_invariants(spark, d):
    return records(spark, d).select("record_id", V.origin().alias("origin"), V.sound().alias("sound"))


@query(f"WITH {CHECKED} SELECT record_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(ne AS BIGINT) AS nepali, CAST(hi AS BIGINT) AS hindi, {_NEGATED} AS negated, CASE WHEN found <> 'roman' THEN 'deva' WHEN {_count(X.NEPALI_ROMAN, X.NEPALI_ROMAN_END)} > 0 THEN 'roman' ELSE 'en' END AS language FROM w")
def language_markers(spark, d):
    m, deva = F.col("message"), F.col("script").eqNullSafe("deva")
    ws = F.col("_words")
    roman = F.col("_roman")
    worded = records(spark, d).select("record_id", "script", "message", X.words(m).alias("_words"))
    marked = worded.withColumn("_roman", X.nepali_markers(m, "roman", ws))
    nepali = F.when(deva, X.nepali_markers(m, "deva", ws)).otherwise(roman)
    hindi = F.when(deva, X.hindi_markers(m, "deva", ws)).otherwise(X.hindi_markers(m, "roman", ws))
    return marked.select(
        "record_id", F.size(ws).cast("long").alias("n_words"), nepali.cast("long").alias("nepali"), hindi.cast("long").alias("hindi"), X.has_negation(m, ws).alias("negated"), X.question_language(m, ws, roman).alias("language")
    )


def _mix(spark, d):
    """Clean records, style variants whose groups may be missing, and outside records for two splits."""
    r = records(spark, d)
    where, k = V.origin(), F.col("doc_id")
    clean = r.where(where.isin("synthetic", "translated") & (F.floor(k / 4) % 7 != 0))
    outside = r.where(where == "external")
    return mix(clean, r.where(where == "realstyle"), {"train": outside.where(k % 2 == 0), "calib": outside.where(k % 2 == 1)}, "doc_id", "mix-1")


MIX = f"""{RECORDS}, n AS (SELECT doc_id, grp, {_NORM_MESSAGE} AS t FROM r WHERE origin IN ('synthetic', 'translated') AND (doc_id // 4) % 7 <> 0), {_TAIL},
  e AS (SELECT ga AS x, gb AS y FROM pairs UNION SELECT gb, ga FROM pairs), gs AS (SELECT DISTINCT grp FROM n), reach AS (SELECT grp AS g, grp AS r FROM gs UNION SELECT reach.g, e.y FROM reach JOIN e ON e.x = reach.r),
  cl AS (SELECT g AS grp, min(r) AS cluster FROM reach GROUP BY g), sp AS (SELECT grp, {sql_assign(sql_uniform('mix-1', 'cluster'))} AS split FROM cl),
  mx AS (SELECT r.*, split, 'clean' AS part FROM r JOIN n USING (doc_id) JOIN sp ON sp.grp = r.grp UNION ALL SELECT r.*, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'calib' END, 'external' FROM r WHERE origin = 'external'
    UNION ALL SELECT r.*, split, 'realstyle' FROM r LEFT JOIN sp ON sp.grp = r.grp WHERE origin = 'realstyle'),
  pl AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY CASE part WHEN 'clean' THEN 0 WHEN 'external' THEN 1 ELSE 2 END, doc_id) - 1 AS place FROM mx WHERE split IS NOT NULL)"""


@query(f"WITH RECURSIVE {MIX} SELECT record_id, split, part, place FROM pl")
def build_splits(spark, d):
    return _mix(spark, d)[0].select("record_id", "split", "part", "place")


@query(f"WITH RECURSIVE {MIX} SELECT record_id FROM mx WHERE split IS NULL")
def unplaced_variants(spark, d):
    return _mix(spark, d)[1].select("record_id")


@query(f"""WITH RECURSIVE {MIX}, x AS (SELECT split, 'records' AS section, 'all' AS key FROM pl UNION ALL SELECT split, 'script', coalesce(script, '(none)') FROM pl UNION ALL SELECT split, 'domain', domain FROM pl
  UNION ALL SELECT split, 'origin', origin FROM pl UNION ALL SELECT split, 'clarification', CAST(asks AS VARCHAR) FROM pl), c AS (SELECT split, section, key, count(*) AS n FROM x GROUP BY ALL)
  SELECT * FROM c UNION ALL SELECT split, 'distinct', 'groups', count(DISTINCT grp) FROM pl GROUP BY 1 UNION ALL SELECT split, 'distinct', 'scenarios', count(DISTINCT scenario_id) FROM pl GROUP BY 1""")
def split_mix_summary(spark, d):
    return split_summary(_mix(spark, d)[0])


SHARES = f"{MIX}, c AS (SELECT domain, issue, count(*) AS n FROM pl WHERE split = 'train' AND issue IS NOT NULL GROUP BY 1, 2), sh_ AS (SELECT domain, issue, n, round(n / sum(n) OVER (PARTITION BY domain), 4) AS share FROM c)"


@query(f"WITH RECURSIVE {SHARES} SELECT domain, issue, n, share FROM sh_")
def train_label_shares(spark, d):
    return label_shares(_mix(spark, d)[0].where("split = 'train'"))


@query(f"WITH RECURSIVE {SHARES} SELECT domain, min(share) AS least, max(share) AS most FROM sh_ GROUP BY 1")
def train_share_range(spark, d):
    return share_range(label_shares(_mix(spark, d)[0].where("split = 'train'")))


@query(f"WITH RECURSIVE {MIX} SELECT grp AS scenario_group_id, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM pl GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leaks(spark, d):
    return leaks(_mix(spark, d)[0], "scenario_group_id").select("scenario_group_id", F.array_join("splits", ",").alias("splits"))
