"""Classification metrics over a frame with gold, pred, conf and p_gold columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.exporting import running

BINS, TINY = 15, 1e-12


def ratio(a: Column, b: Column) -> Column:
    """a / b, or null where b is 0."""
    return F.when(b != 0, a / b)


def ratio0(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def brier(p: str, names: list[str], gold: str) -> Column:
    """Squared distance of a distribution (array in the order of ``names``) from the gold category."""
    ordered = F.array(*map(F.lit, names))
    term = lambda x, i: F.pow(x - F.when(F.get(ordered, i) == F.col(gold), 1.0).otherwise(0.0), F.lit(2))
    return F.aggregate(F.transform(p, term), F.lit(0.0), lambda a, x: a + x)


def nll(p: Column) -> Column:
    return -F.log(F.greatest(p, F.lit(TINY)))


def confusion(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return df.groupBy(gold, pred).agg(F.count("*").alias("n"))


def per_category(df: DataFrame) -> DataFrame:
    """support, predicted, hits, precision, recall, f1 for each category that is gold or predicted, from one confusion."""
    cells = confusion(df)
    sides = cells.select(F.col("gold").alias("category"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("hits"))
    sides = sides.union(cells.select("pred", F.lit(0).cast("long"), "n", F.lit(0).cast("long")))
    sums = sides.groupBy("category").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    precision, recall = ratio0(F.col("hits"), F.col("predicted")), ratio0(F.col("hits"), F.col("support"))
    scored = sums.select("*", precision.alias("precision"), recall.alias("recall"))
    return scored.withColumn("f1", ratio0(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def ece(df: DataFrame, conf: str = "conf", correct: str = "correct") -> DataFrame:
    """Expected calibration error over BINS equal bins, as one row (n, ece)."""
    bins = df.groupBy(F.least(F.lit(BINS - 1), F.floor(F.col(conf) * BINS)).alias("bin")).agg(
        F.count("*").alias("n"), F.sum(conf).alias("c"), F.sum(F.col(correct).cast("double")).alias("ok")
    )
    return bins.agg(F.sum("n").alias("n"), (F.sum(F.abs(F.col("c") - F.col("ok"))) / F.sum("n")).alias("ece"))


def coverage_at_error(df: DataFrame, limit: float, order: str, conf: str = "conf", correct: str = "correct") -> DataFrame:
    """(coverage, threshold): the longest prefix by falling confidence, then ``order``, whose error rate is within ``limit``.
    The rows are ranked over ranges of both, so the commonest confidence is no single task."""
    rows = df.select(F.col(conf).alias("c"), F.col(order).alias("o"), (~F.col(correct)).cast("long").alias("w"), F.lit(1).alias("one"))
    ranked = running(rows, [F.desc("c"), F.asc("o")], k="one", errors="w")
    met = F.col("errors") / F.col("k") <= limit
    best = ranked.agg(F.count("*").alias("n"), F.max(F.when(met, F.col("k"))).alias("k"), F.max_by("c", F.when(met, F.col("k"))).alias("threshold"))
    return best.select(F.coalesce(F.col("k") / F.col("n"), F.lit(0.0)).alias("coverage"), "threshold")
