"""Router predictions and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.hashing import resampled
from granary.functions.text import length_bucket
from granary.operators import metrics as M
from granary.plans.base import CUES, PRED, SQL_GROUP, group_of, predictions, query, r6, sql_uniform, table, u

LENGTH = r"CASE WHEN nw <= 12 THEN 'short' WHEN nw <= 30 THEN 'medium' ELSE 'long' END"
N_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"
CLAR = f"""WITH {PRED}, y AS (SELECT quality = 0 AS y, clar AS p FROM pred JOIN labels USING (doc_id))"""
CATEGORY = f"""WITH {PRED}, k AS (SELECT gold AS category FROM pred UNION SELECT pred FROM pred),
  a AS (SELECT category, (SELECT count(*) FROM pred WHERE gold = category) AS support,
    (SELECT count(*) FROM pred WHERE pred.pred = category) AS predicted,
    (SELECT count(*) FROM pred WHERE gold = category AND pred.pred = category) AS hits FROM k),
  pr AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall FROM a),
  f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"""


@query(f"WITH {PRED} SELECT gold AS lang, count(*) AS n, round(avg(CAST(correct AS INT)), 6) AS accuracy FROM pred GROUP BY 1")
def rule_router_accuracy(spark, d):
    return predictions(spark, d).groupBy(F.col("gold").alias("lang")).agg(F.count("*").alias("n"), r6(F.avg(F.col("correct").cast("int"))).alias("accuracy"))


@query(f"WITH {PRED} SELECT doc_id, " + ", ".join(f"CAST(s_{c} AS DOUBLE) AS s_{c}" for c in CUES) + " FROM pred")
def rule_router_scores(spark, d):
    return predictions(spark, d).select("doc_id", *(F.get("scores", F.lit(i)).alias(f"s_{c}") for i, c in enumerate(CUES)))


@query(f"WITH {PRED} SELECT doc_id, pred, round(conf, 6) AS conf, CAST(clar AS DOUBLE) AS clar, rule FROM pred")
def rule_router_predictions(spark, d):
    return predictions(spark, d).select("doc_id", "pred", r6(F.col("conf")).alias("conf"), "clar", "rule")


@query(CATEGORY + f""" SELECT (SELECT count(*) FROM pred) AS n, (SELECT round(avg(CAST(correct AS INT)), 6) FROM pred) AS accuracy,
  (SELECT round(avg(-ln(greatest(p_gold, 1e-12))), 6) FROM pred) AS nll, (SELECT round(avg(brier), 6) FROM pred) AS brier,
  (SELECT round(avg(f1), 6) FROM f WHERE support > 0) AS macro_f1""")
def issue_metrics(spark, d):
    p = predictions(spark, d)
    a = p.agg(F.count("*").alias("n"), r6(F.avg(F.col("correct").cast("int"))).alias("accuracy"), r6(F.avg(M.nll(F.col("p_gold")))).alias("nll"), r6(F.avg("brier")).alias("brier"))
    b = M.per_category(p).where("support > 0").agg(r6(F.avg("f1")).alias("macro_f1"))
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")


@query(CATEGORY + " SELECT category, support, predicted, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def per_category_f1(spark, d):
    return M.per_category(predictions(spark, d)).select("category", "support", "predicted", "hits", *(r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {PRED} SELECT gold, pred, count(*) AS n FROM pred GROUP BY 1, 2")
def confusion(spark, d):
    return M.confusion(predictions(spark, d))


@query(f"""WITH {PRED}, b AS (SELECT least(14, floor(conf * 15)) AS bin, count(*) AS n, sum(conf) AS c, sum(CAST(correct AS INT)) AS ok FROM pred GROUP BY 1)
  SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(abs(c - ok)) / sum(n), 6) AS ece FROM b""")
def calibration_ece(spark, d):
    return M.ece(predictions(spark, d)).select("n", r6(F.col("ece")).alias("ece"))


@query(CLAR + """, a AS (SELECT count(*) AS n, count(*) FILTER (WHERE y) AS positives, count_if(y AND p >= 0.5) AS tp, count_if(NOT y AND p >= 0.5) AS fp, count_if(y AND p < 0.5) AS fn,
    avg(CAST((p >= 0.5) = y AS INT)) AS accuracy, avg(-ln(greatest(CASE WHEN y THEN p ELSE 1 - p END, 1e-12))) AS nll, avg((p - CAST(y AS INT)) ** 2) AS brier FROM y),
  b AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM a)
  SELECT n, positives, round(precision, 6) AS precision, round(recall, 6) AS recall,
    round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1,
    round(accuracy, 6) AS accuracy, round(nll, 6) AS nll, round(brier, 6) AS brier FROM b""")
def clarification_metrics(spark, d):
    y = predictions(spark, d).join(table(spark, d, "labels"), "doc_id").select((F.col("quality") == 0).alias("y"), F.col("clar").alias("p"))
    said = F.col("p") >= 0.5
    a = y.agg(
        F.count("*").alias("n"), F.count_if("y").alias("positives"), F.count_if(F.col("y") & said).alias("tp"), F.count_if(~F.col("y") & said).alias("fp"),
        F.count_if(F.col("y") & ~said).alias("fn"), F.avg((said == F.col("y")).cast("int")).alias("accuracy"),
        F.avg(M.nll(F.when(F.col("y"), F.col("p")).otherwise(1 - F.col("p")))).alias("nll"), F.avg(F.pow(F.col("p") - F.col("y").cast("int"), F.lit(2))).alias("brier"),
    )
    a = a.select("*", M.ratio0(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), M.ratio0(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    f1 = M.ratio0(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return a.withColumn("f1", f1).select("n", "positives", *(r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "accuracy", "nll", "brier")))


SQL_COVER = """o AS (SELECT conf, correct, row_number() OVER w AS k, sum(CAST(NOT correct AS INT)) OVER (ORDER BY conf DESC, doc_id ROWS UNBOUNDED PRECEDING) AS e FROM {src} WINDOW w AS (ORDER BY conf DESC, doc_id)),
  m AS (SELECT max(k) AS k FROM o WHERE e / k <= 0.05)"""


@query(f"WITH {PRED}, {SQL_COVER.format(src='pred')} SELECT round(coalesce(m.k / (SELECT count(*) FROM pred), 0), 6) AS coverage, (SELECT round(conf, 6) FROM o WHERE o.k = m.k) AS threshold FROM m")
def coverage_at_error(spark, d):
    return M.coverage_at_error(predictions(spark, d), 0.05, "doc_id").select(r6(F.col("coverage")).alias("coverage"), r6(F.col("threshold")).alias("threshold"))


SPLIT_U = sql_uniform("calib", "CAST(doc_id AS VARCHAR)")


@query(f"""WITH {PRED}, calib AS (SELECT * FROM pred WHERE {SPLIT_U} < 0.5), test AS (SELECT * FROM pred WHERE {SPLIT_U} >= 0.5), {SQL_COVER.format(src='calib')},
  th AS (SELECT (SELECT conf FROM o WHERE o.k = m.k) AS threshold FROM m)
  SELECT round(max(threshold), 6) AS threshold, count(*) AS n, count(*) FILTER (WHERE conf >= threshold) AS routed,
    round(count_if(conf >= threshold) / greatest(1, count(*)), 6) AS coverage, round(count_if(conf >= threshold AND NOT correct) / greatest(1, count_if(conf >= threshold)), 6) AS error FROM test, th""")
def routing_at_threshold(spark, d):
    p = predictions(spark, d).select("doc_id", "conf", "correct")
    draw = u("calib", F.col("doc_id"))
    chosen = M.coverage_at_error(p.where(draw < 0.5), 0.05, "doc_id").select("threshold", F.lit(1).alias("k"))
    test = p.where(draw >= 0.5).withColumn("k", F.lit(1)).join(F.broadcast(chosen), "k", "left")
    on = F.coalesce(F.col("conf") >= F.col("threshold"), F.lit(False))
    a = test.agg(r6(F.max("threshold")).alias("threshold"), F.count("*").alias("n"), F.count_if(on).alias("routed"), F.count_if(on & ~F.col("correct")).alias("wrong"))
    one = F.lit(1)
    return a.select("threshold", "n", "routed", r6(F.col("routed") / F.greatest(one, "n")).alias("coverage"), r6(F.col("wrong") / F.greatest(one, "routed")).alias("error"))


@query(f"""WITH {PRED}, x AS (SELECT *, {N_WORDS} AS nw FROM pred), y AS (SELECT gold, source, {LENGTH} AS length, correct, p_gold FROM x)
  SELECT CASE WHEN grouping(gold) = 0 THEN 'gold' WHEN grouping(source) = 0 THEN 'source' ELSE 'length' END AS slice, coalesce(gold, source, length) AS key,
    count(*) AS n, round(avg(CAST(correct AS INT)), 6) AS accuracy, round(avg(-ln(greatest(p_gold, 1e-12))), 6) AS nll FROM y GROUP BY GROUPING SETS ((gold), (source), (length))""")
def metric_slices(spark, d):
    p = predictions(spark, d).withColumn("length", length_bucket(F.col("text")))
    g = p.groupingSets([["gold"], ["source"], ["length"]], "gold", "source", "length").agg(
        F.grouping("gold").alias("g1"), F.grouping("source").alias("g2"), F.count("*").alias("n"), r6(F.avg(F.col("correct").cast("int"))).alias("accuracy"), r6(F.avg(M.nll(F.col("p_gold")))).alias("nll"))
    return g.select(F.when(F.col("g1") == 0, "gold").when(F.col("g2") == 0, "source").otherwise("length").alias("slice"), F.coalesce("gold", "source", "length").alias("key"), "n", "accuracy", "nll")


@query(CATEGORY + """, z AS (SELECT (SELECT count(*) FROM pred) AS total)
  SELECT category, support, predicted, round(support / total, 6) AS true_share, round(predicted / total, 6) AS pred_share,
    round(CASE WHEN support > 0 THEN (predicted / total) / (support / total) END, 6) AS share_ratio, round(CASE WHEN support > 0 THEN hits / support END, 6) AS recall,
    CASE WHEN support >= 10 THEN (predicted / total) / (support / total) <= 1.5 END AS share_ok, CASE WHEN support >= 10 THEN hits / support >= 0.5 END AS recall_ok FROM f, z""")
def bias_checks(spark, d):
    c = M.per_category(predictions(spark, d))
    total = F.lit(1).alias("k")
    c = c.withColumn("k", F.lit(1)).join(F.broadcast(c.agg(F.sum("support").alias("total")).withColumn("k", F.lit(1))), "k")
    true, pred = F.col("support") / F.col("total"), F.col("predicted") / F.col("total")
    big = F.col("support") >= 10
    share, recall = M.ratio(pred, true), M.ratio(F.col("hits"), F.col("support"))
    return c.select("category", "support", "predicted", r6(true).alias("true_share"), r6(pred).alias("pred_share"), r6(share).alias("share_ratio"), r6(recall).alias("recall"), F.when(big, share <= 1.5).alias("share_ok"), F.when(big, recall >= 0.5).alias("recall_ok"))


SAMPLES = 1000
SQL_POISSON = "CASE " + " ".join(f"WHEN u < {b} THEN {k}" for k, b in enumerate([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.9999988747974020])) + " ELSE 9 END"
SQL_BOOT = f"""g AS (SELECT {SQL_GROUP} AS grp, count(*) AS n, sum(CAST(correct AS INT)) AS a, sum(CAST(gold = 'en' AS INT)) AS b FROM pred GROUP BY 1),
  bs AS (SELECT sample, n, a, b, {sql_uniform('boot', "CAST(sample AS VARCHAR) || ':' || grp")} AS u FROM g, range({SAMPLES}) r(sample)),
  v AS (SELECT sample, sum(n * m) AS n, sum(a * m) AS a, sum(b * m) AS b FROM (SELECT *, {SQL_POISSON} AS m FROM bs) GROUP BY 1)"""
#: Index of a percentile-interval's ends among sorted samples.
LOW, HIGH = int(0.025 * SAMPLES), int(0.975 * SAMPLES) - 1


def _samples(spark, d):
    """Sums of each bootstrap sample over whole groups; groups are reduced first."""
    p = predictions(spark, d).groupBy(group_of(F.col("doc_id")).alias("grp")).agg(
        F.count("*").alias("n"), F.sum(F.col("correct").cast("int")).alias("a"), F.sum((F.col("gold") == "en").cast("int")).alias("b"))
    return resampled(p, "grp", ["n", "a", "b"], "boot", SAMPLES)


def _interval(df, value):
    v = df.select(value.alias("v")).agg(F.array_sort(F.collect_list("v")).alias("v"))
    return v.select(r6(F.get("v", F.lit(LOW))).alias("low"), r6(F.get("v", F.lit(HIGH))).alias("high"))


@query(f"WITH {PRED}, {SQL_BOOT}, o AS (SELECT list_sort(list(a / n)) AS v FROM v) SELECT round(v[{LOW + 1}], 6) AS low, round(v[{HIGH + 1}], 6) AS high FROM o")
def bootstrap_ci(spark, d):
    return _interval(_samples(spark, d), F.col("a") / F.col("n"))


@query(f"WITH {PRED}, {SQL_BOOT}, o AS (SELECT list_sort(list((a - b) / n)) AS v FROM v) SELECT round(v[{LOW + 1}], 6) AS low, round(v[{HIGH + 1}], 6) AS high FROM o")
def paired_difference(spark, d):
    return _interval(_samples(spark, d), (F.col("a") - F.col("b")) / F.col("n"))
