"""Predictions of the records that the tables are turned into, joined by id and judged in full."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions.hashing import resampled
from granary.operators import evaluating as E
from granary.operators.answering import act
from granary.plans.base import query, r6, sql_uniform, u
from granary.plans.evaluation import HIGH, LOW, SAMPLES, SQL_POISSON
from granary.plans.records import CATEGORIES, DOMAINS, RECORDS, _case, _listed, records


def predicted(spark, d, seed: str = "a"):
    """Made-up predictions of eight records in nine: the category that the id points to is the likeliest in most."""
    k = F.col("doc_id")
    r = records(spark, d).where((k % 9 != 0) & (F.col("domain") != "garage"))
    draw = lambda what: u(f"{seed}:{what}", k)
    at = F.floor(k / 3) % 4
    raw = [F.lit(0.05) + draw(f"c{i}") + F.when((at == i) & (draw("hit") < 0.7), 1.0).otherwise(0.0) for i in range(4)]
    total = raw[0] + raw[1] + raw[2] + raw[3]
    names = F.coalesce(*(F.when(F.col("domain") == x, F.array(*map(F.lit, c))) for x, c in CATEGORIES.items()))
    said = F.when(F.col("labels.clarification_needed"), 0.3 + 0.7 * draw("said")).otherwise(0.7 * draw("said"))
    return r.select("record_id", names.alias("names"), F.array(*(x / total for x in raw)).alias("p"), said.alias("said"))


def pairs(spark, d, seed: str = "a"):
    """Records from outside are no part of an evaluation."""
    return E.pairs(records(spark, d), predicted(spark, d, seed)).where("origin <> 'external'")


def _sql_pairs(seed: str, name: str) -> str:
    draw = lambda what: sql_uniform(f"{seed}:{what}", "CAST(doc_id AS VARCHAR)")
    raw = ", ".join(f"0.05::DOUBLE + {draw(f'c{i}')} + CASE WHEN idx = {i} AND {draw('hit')} < 0.7 THEN 1.0::DOUBLE ELSE 0::DOUBLE END AS w{i}" for i in range(4))
    p = ", ".join(f"w{i} / (w0 + w1 + w2 + w3) AS p{i}" for i in range(4))
    best = "CASE " + " ".join(f"WHEN p{i} = conf THEN {i}" for i in range(4)) + " END"
    return f"""{name}0 AS (SELECT *, {_case(lambda x: _listed(CATEGORIES[x]))} AS names, {raw}, CASE WHEN asks THEN 0.3 + 0.7 * {draw('said')} ELSE 0.7 * {draw('said')} END AS said
      FROM r WHERE doc_id % 9 <> 0 AND domain <> 'garage' AND origin <> 'external'),
    {name}1 AS (SELECT *, {p} FROM {name}0), {name}2 AS (SELECT *, greatest(p0, p1, p2, p3) AS conf, coalesce(list_position(names, issue), 0) AS at_ FROM {name}1),
    {name}3 AS (SELECT *, CASE WHEN issue IS NOT NULL THEN domain || '/' || issue END AS gold, domain || '/' || names[{best} + 1] AS pred, CASE at_ WHEN 1 THEN p0 WHEN 2 THEN p1 WHEN 3 THEN p2 WHEN 4 THEN p3 ELSE 0 END AS p_gold,
      {' + '.join(f'(p{i} - CASE WHEN at_ = {i + 1} THEN 1 ELSE 0 END) ** 2' for i in range(4))} AS brier, CASE WHEN family LIKE 'multi%' THEN family ELSE split_part(family, ':', 1) END AS fam,
      len(list_filter(regexp_split_to_array(message, '\\s+'), lambda x: x <> '')) AS nw FROM {name}2),
    {name} AS (SELECT *, gold = pred AS correct, CASE WHEN nw <= 12 THEN 'short' WHEN nw <= 30 THEN 'medium' ELSE 'long' END AS length FROM {name}3)"""


PAIRS = f"{RECORDS}, {_sql_pairs('a', 'pr')}, hd AS (SELECT * FROM pr WHERE gold IS NOT NULL)"
CATS = f"""{PAIRS}, kk AS (SELECT domain, gold AS category FROM hd UNION SELECT domain, pred FROM hd), tt AS (SELECT domain, count(*) AS total FROM hd GROUP BY 1),
  ca AS (SELECT category, total, (SELECT count(*) FROM hd WHERE gold = category) AS support, (SELECT count(*) FROM hd WHERE pred = category) AS predicted, (SELECT count(*) FROM hd WHERE gold = category AND pred = category) AS hits,
    (SELECT count(*) FROM hd WHERE gold = category AND pred LIKE '%/other' AND gold NOT LIKE '%/other') AS lost FROM kk JOIN tt USING (domain)),
  bi AS (SELECT category, support, predicted, hits, support / total AS true_share, predicted / total AS pred_share, CASE WHEN support > 0 THEN (predicted / total) / (support / total) WHEN predicted > 0 THEN CAST('inf' AS DOUBLE) END AS share_ratio,
    CASE WHEN support > 0 THEN hits / support END AS recall, CASE WHEN support > 0 THEN lost / support END AS recall_into_other FROM ca)"""


@query(f"""WITH {CATS}, pf AS (SELECT CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r FROM ca WHERE support > 0),
  ec AS (SELECT least(14, floor(conf * 15)) AS bin, count(*) AS n, sum(conf) AS c, sum(CAST(correct AS INT)) AS ok FROM hd GROUP BY 1),
  o AS (SELECT conf, row_number() OVER (ORDER BY conf DESC, record_id) AS k, sum(CAST(NOT correct AS INT)) OVER (ORDER BY conf DESC, record_id ROWS UNBOUNDED PRECEDING) AS e FROM hd), m AS (SELECT max(k) AS k FROM o WHERE e / k <= 0.05)
  SELECT (SELECT count(*) FROM hd) AS n, (SELECT round(avg(CAST(correct AS INT)), 6) FROM hd) AS accuracy, (SELECT round(avg(-ln(greatest(p_gold, 1e-12))), 6) FROM hd) AS nll, (SELECT round(avg(brier), 6) FROM hd) AS brier,
    (SELECT round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) FROM pf) AS macro_f1, (SELECT round(sum(abs(c - ok)) / sum(n), 6) FROM ec) AS ece,
    (SELECT round(coalesce(m.k / (SELECT count(*) FROM hd), 0), 6) FROM m) AS coverage, (SELECT round(conf, 6) FROM o, m WHERE o.k = m.k) AS threshold""")
def evaluate_joined(spark, d):
    s = E.issue_summary(pairs(spark, d))
    return s.select("n", *(r6(F.col(c)).alias(c) for c in ("accuracy", "nll", "brier", "macro_f1", "ece", "coverage", "threshold")))


@query(f"""WITH {PAIRS}, a AS (SELECT count(*) AS n, count_if(asks) AS positives, count_if(asks AND said >= 0.5) AS tp, count_if(NOT asks AND said >= 0.5) AS fp, count_if(asks AND said < 0.5) AS fn, avg(CAST((said >= 0.5) = asks AS INT)) AS accuracy,
    avg(-ln(greatest(CASE WHEN asks THEN said ELSE 1 - said END, 1e-12))) AS nll, avg((said - CAST(asks AS INT)) ** 2) AS brier FROM pr),
  b AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM a),
  e AS (SELECT least(14, floor(greatest(said, 1 - said) * 15)) AS bin, count(*) AS n, sum(greatest(said, 1 - said)) AS c, sum(CAST((said >= 0.5) = asks AS INT)) AS ok FROM pr GROUP BY 1)
  SELECT n, positives, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(accuracy, 6) AS accuracy, round(nll, 6) AS nll, round(brier, 6) AS brier,
    (SELECT round(sum(abs(c - ok)) / sum(n), 6) FROM e) AS ece FROM b""")
def clarification_joined(spark, d):
    c = E.clarification_summary(pairs(spark, d))
    return c.select("n", "positives", *(r6(F.col(x)).alias(x) for x in ("precision", "recall", "f1", "accuracy", "nll", "brier", "ece")))


@query(f"""WITH {PAIRS}, g AS (SELECT CASE WHEN grouping(domain) = 0 THEN 'domain' WHEN grouping(origin) = 0 THEN 'origin' WHEN grouping(fam) = 0 THEN 'family' ELSE 'length' END AS slice, coalesce(domain, origin, fam, length) AS key,
    count(*) AS n, count(gold) AS issue_n, avg(CASE WHEN gold IS NOT NULL THEN CAST(correct AS INT) END) AS acc, count_if(asks AND said >= 0.5) AS tp, count_if(NOT asks AND said >= 0.5) AS fp, count_if(asks AND said < 0.5) AS fn
    FROM pr GROUP BY GROUPING SETS ((domain), (origin), (fam), (length))),
  h AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM g)
  SELECT slice, key, n, issue_n, round(acc, 6) AS issue_accuracy, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS clarification_f1 FROM h""")
def evaluation_slices(spark, d):
    return E.slices(pairs(spark, d)).select("slice", "key", "n", "issue_n", r6(F.col("issue_accuracy")).alias("issue_accuracy"), r6(F.col("clarification_f1")).alias("clarification_f1"))


_BIAS = ("true_share", "pred_share", "share_ratio", "recall", "recall_into_other")


@query(f"WITH {CATS} SELECT category, support, predicted, hits, " + ", ".join(f"CASE WHEN isinf({c}) THEN {c} ELSE round({c}, 6) END AS {c}" for c in _BIAS) + " FROM bi")
def bias_by_category(spark, d):
    return E.bias_by_category(pairs(spark, d)).select("category", "support", "predicted", "hits", *(r6(F.col(c)).alias(c) for c in _BIAS))


@query(f"""WITH {CATS}, s AS (SELECT count_if(support >= 10) AS checked, max(CASE WHEN support >= 10 THEN share_ratio END) AS most, min(CASE WHEN support >= 10 THEN recall END) AS least,
    coalesce(sum(support) FILTER (WHERE category LIKE '%/other'), 0) AS og, coalesce(sum(predicted) FILTER (WHERE category LIKE '%/other'), 0) AS op, coalesce(sum(hits) FILTER (WHERE category LIKE '%/other'), 0) AS oh FROM bi),
  q AS (SELECT avg(CAST(asks AS INT)) AS t, avg(CAST(said >= 0.5 AS INT)) AS p, count(*) AS n FROM pr),
  v AS (SELECT 'share_ratio' AS verdict, most <= 1.5 AS passed, most AS value, checked FROM s UNION ALL SELECT 'other_share_ratio', op / og <= 1.5, op / og, og FROM s UNION ALL SELECT 'recall', least >= 0.5, least, checked FROM s
    UNION ALL SELECT 'other_precision', CASE WHEN op > 0 OR og > 0 THEN coalesce(oh / op >= 0.7, false) END, oh / op, op FROM s UNION ALL SELECT 'clarify_rate', abs(p - t) <= 0.05, abs(p - t), n FROM q)
  SELECT verdict, passed, round(value, 6) AS value, CAST(checked AS BIGINT) AS checked FROM v""")
def bias_verdicts(spark, d):
    return E.bias_verdicts(pairs(spark, d)).select("verdict", "passed", r6(F.col("value")).alias("value"), "checked")


@query(f"""WITH {CATS}, a AS (SELECT 'recall' AS list, row_number() OVER (ORDER BY recall, category) AS place, category, recall AS value FROM bi WHERE support >= 10),
  b AS (SELECT 'into_other' AS list, row_number() OVER (ORDER BY recall_into_other DESC, category) AS place, category, recall_into_other AS value FROM bi WHERE recall_into_other > 0)
  SELECT list, place, category, round(value, 6) AS value FROM a WHERE place <= 5 UNION ALL SELECT list, place, category, round(value, 6) FROM b WHERE place <= 10""")
def worst_categories(spark, d):
    return E.worst(E.bias_by_category(pairs(spark, d))).select("list", "place", "category", r6(F.col("value")).alias("value"))


_BOTH = f"""{PAIRS}, {_sql_pairs('b', 'ps')}, tw AS (SELECT x.grp, x.correct AS a, y.correct AS b FROM hd x JOIN ps y USING (record_id)),
  g AS (SELECT grp, count(*) AS n, sum(CAST(a AS INT)) AS a, sum(CAST(b AS INT)) AS b FROM tw GROUP BY 1),
  bs AS (SELECT sample, n, a, b, {sql_uniform('pair', "CAST(sample AS VARCHAR) || ':' || grp")} AS u FROM g, range({SAMPLES}) r(sample)),
  v AS (SELECT sample, sum((a - b) * m) / sum(n * m) AS x FROM (SELECT *, {SQL_POISSON} AS m FROM bs) GROUP BY 1), o AS (SELECT list_sort(list(x)) AS v FROM v)"""


@query(f"WITH {_BOTH} SELECT (SELECT CAST(sum(n) AS BIGINT) FROM g) AS n, round((SELECT sum(a - b) / sum(n) FROM g), 6) AS difference, round(v[{LOW + 1}], 6) AS low, round(v[{HIGH + 1}], 6) AS high FROM o")
def paired_predictors(spark, d):
    """Two predictors on the records that both have predicted, and the interval of their difference over whole groups."""
    a, b = (E.hard(pairs(spark, d, s)).select("record_id", "scenario_group_id", F.col("correct").alias(s)) for s in "ab")
    g = a.join(b.drop("scenario_group_id"), "record_id").groupBy("scenario_group_id").agg(F.count("*").alias("n"), *(F.sum(F.col(s).cast("int")).alias(s) for s in "ab"))
    drawn = resampled(g, "scenario_group_id", ["n", "a", "b"], "pair", SAMPLES)
    v = drawn.select(((F.col("a") - F.col("b")) / F.col("n")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("v"))
    whole = g.agg(F.sum("n").alias("n"), (F.sum(F.col("a") - F.col("b")) / F.sum("n")).alias("difference"))
    return whole.crossJoin(F.broadcast(v)).select("n", r6(F.col("difference")).alias("difference"), r6(F.get("v", F.lit(LOW))).alias("low"), r6(F.get("v", F.lit(HIGH))).alias("high"))


@query(f"""WITH {PAIRS}, e AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'epoch-1' WHEN doc_id % 3 = 1 THEN 'epoch-2' ELSE 'epoch-3' END AS checkpoint, avg(-ln(greatest(p_gold, 1e-12))) AS nll FROM hd GROUP BY 1)
  SELECT checkpoint, round(nll, 6) AS nll, checkpoint = (SELECT arg_min(checkpoint, nll) FROM e) AS best FROM e""")
def checkpoint_choice(spark, d):
    k = F.substr("record_id", F.lit(2)).cast("long") % 3
    scores = E.hard(pairs(spark, d)).select(F.when(k == 0, "epoch-1").when(k == 1, "epoch-2").otherwise("epoch-3").alias("checkpoint"), "p_gold")
    return E.best_checkpoint(scores, "checkpoint", "p_gold").select("checkpoint", r6(F.col("nll")).alias("nll"), "best")


_DIFF = ", ".join(f"abs(x.p{i} - y.p{i})" for i in range(4))
_FIRST = lambda t: "CASE " + " ".join(f"WHEN {t}.p{i} = {t}.conf THEN {i}" for i in range(4)) + " END"


@query(f"WITH {PAIRS}, {_sql_pairs('b', 'ps')} SELECT count(*) AS n, round(max(greatest({_DIFF})), 6) AS largest, count_if({_FIRST('x')} <> {_FIRST('y')}) AS flips, (SELECT count(*) FROM pr WHERE doc_id % 4 = 3) AS missing FROM pr x JOIN ps y USING (record_id) WHERE x.doc_id % 4 <> 3")
def model_parity(spark, d):
    """Two models' probabilities compared; the reference lacks a quarter of the records."""
    outside = records(spark, d).where("source.generator = 'external'").select("record_id")
    ours, other = (predicted(spark, d, s).join(outside, "record_id", "left_anti").select("record_id", "p") for s in "ab")
    return E.parity(ours, other.where(F.substr("record_id", F.lit(2)).cast("long") % 4 != 3), ["record_id"]).select("n", r6(F.col("largest")).alias("largest"), "flips", "missing")


@query(f"""WITH {PAIRS}, z AS (SELECT record_id, [exp((w0 - greatest(w0, w1, w2, w3)) / 1.5), exp((w1 - greatest(w0, w1, w2, w3)) / 1.5), exp((w2 - greatest(w0, w1, w2, w3)) / 1.5), exp((w3 - greatest(w0, w1, w2, w3)) / 1.5)] AS e, conf, said FROM pr)
  SELECT record_id, round(list_max(e) / (e[1] + e[2] + e[3] + e[4]), 6) AS top, round((conf - 0.25) / 0.75, 4) AS confidence, CASE WHEN said >= 0.5 THEN 'clarify' WHEN conf >= 0.4 THEN 'route' ELSE 'triage' END AS decision FROM z""")
def served_answers(spark, d):
    """Temperature softmax of scores, rescaled confidence, and the three-way decision."""
    outside = records(spark, d).where("source.generator = 'external'").select("record_id")
    p = predicted(spark, d).join(outside, "record_id", "left_anti").join(records(spark, d).select("record_id", "doc_id"), "record_id")
    k = F.col("doc_id")
    at = F.floor(k / 3) % 4
    raw = F.array(*(F.lit(0.05) + u(f"a:c{i}", k) + F.when((at == i) & (u("a:hit", k) < 0.7), 1.0).otherwise(0.0) for i in range(4)))

    return p.select("record_id", r6(F.array_max(E.softmax(raw, 1.5))).alias("top"), E.rescaled(F.col("p")).alias("confidence"), act(F.col("said"), F.array_max("p"), 0.5, 0.4).alias("decision"))


_ORDERED = "row_number() OVER (ORDER BY record_id) - 1"


@query(f"WITH {PAIRS}, l AS (SELECT record_id, {_ORDERED} AS line FROM pr) SELECT record_id, line FROM l WHERE line % greatest(1, (SELECT count(*) FROM l) // 20) = 0 AND line < 20 * greatest(1, (SELECT count(*) FROM l) // 20)")
def stride_sample(spark, d):
    from granary.operators.exporting import numbered

    lines = numbered(pairs(spark, d).select("record_id"), "record_id", "line")
    return E.stride(lines, "line", lines.count(), 20)
