"""Predictions joined to records by id, and everything that is measured on the pairs.

``pairs`` has record_id, domain, gold (null for soft labels), asks, said (probability that it must be asked), pred, conf,
p_gold, brier, origin, family and length; categories belong to their domain, so names are ``domain/category``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import length_bucket
from granary.operators import metrics as M
from granary.operators.validation import origin

#: Limits of the bias checks.
MOST_SHARE, LEAST_RECALL, LEAST_PRECISION, MOST_GAP, SUPPORT = 1.5, 0.5, 0.7, 0.05, 10


def argmax(names: Column, p: Column) -> Column:
    """The first name of the largest probability."""
    return F.get(names, F.array_position(p, F.array_max(p)).cast("int") - 1)


def pairs(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """Records with their prediction; others are left out. ``predictions`` has record_id, names and p (arrays in canonical
    order) and said."""
    met = records.join(predictions, "record_id")
    name = lambda c: F.concat_ws("/", F.col("domain"), c)
    issue = F.col("labels.issue")
    place = F.array_position("names", issue).cast("int") - 1
    square = F.transform("p", lambda x, i: F.pow(x - F.when(i == place, 1.0).otherwise(0.0), F.lit(2)))
    family = F.col("difficulty_family")
    return met.select(
        "record_id", "domain", "scenario_group_id",
        F.when(issue.isNotNull(), name(issue)).alias("gold"),
        F.col("labels.clarification_needed").alias("asks"), "said",
        name(argmax(F.col("names"), F.col("p"))).alias("pred"), F.array_max("p").alias("conf"),
        F.coalesce(F.get("p", place), F.lit(0.0)).alias("p_gold"),
        F.aggregate(square, F.lit(0.0), lambda a, x: a + x).alias("brier"),
        origin().alias("origin"),
        F.when(family.startswith("multi"), family).otherwise(F.split_part(family, F.lit(":"), F.lit(1))).alias("family"),
        length_bucket(F.col("message")).alias("length"),
    ).withColumn("correct", F.col("gold") == F.col("pred"))


def hard(df: DataFrame) -> DataFrame:
    return df.where("gold IS NOT NULL")


def issue_summary(df: DataFrame, limit: float = 0.05) -> DataFrame:
    """One row: n, accuracy, macro_f1, nll, brier, ece and the coverage at an error of ``limit``, over hard labels."""
    some = hard(df)
    one = F.lit(1).alias("_k")
    a = some.agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy"), F.avg(M.nll(F.col("p_gold"))).alias("nll"), F.avg("brier").alias("brier"))
    f = M.per_category(some).where("support > 0").agg(F.avg("f1").alias("macro_f1"))
    e = M.ece(some).select("ece")
    c = M.coverage_at_error(some, limit, "record_id").select("coverage", "threshold")
    out = a.select("*", one)
    for other in (f, e, c):
        out = out.join(other.select("*", one), "_k")
    return out.drop("_k")


def _asked(threshold: float) -> tuple[Column, Column]:
    return F.col("asks"), F.col("said") >= threshold


def f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, each 0 where it has no base."""
    precision, recall = M.ratio0(tp, tp + fp), M.ratio0(tp, tp + fn)
    return precision, recall, M.ratio0(2 * precision * recall, precision + recall)


def clarification_summary(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: n, positives, precision, recall, f1, accuracy, nll, brier and ece of the question whether to ask. ``df`` has
    asks and said; rows without ``said`` are left out."""
    some = df.where("said IS NOT NULL")
    y, yes = _asked(threshold)
    p = F.col("said")
    a = some.agg(
        F.count("*").alias("n"), F.count_if(y).alias("positives"), F.count_if(y & yes).alias("tp"), F.count_if(~y & yes).alias("fp"), F.count_if(y & ~yes).alias("fn"),
        F.avg((yes == y).cast("int")).alias("accuracy"), F.avg(M.nll(F.when(y, p).otherwise(1 - p))).alias("nll"), F.avg(F.pow(p - y.cast("int"), F.lit(2))).alias("brier"),
    )
    precision, recall, both = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    e = M.ece(some.select(F.greatest(p, 1 - p).alias("conf"), (yes == y).alias("correct"))).select("ece", F.lit(1).alias("_k"))
    return a.select("n", "positives", precision.alias("precision"), recall.alias("recall"), both.alias("f1"), "accuracy", "nll", "brier", F.lit(1).alias("_k")).join(e, "_k").drop("_k")


def slices(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(slice, key, n, issue_n, issue_accuracy, clarification_f1)`` by domain, origin, family and length, in one pass."""
    names = ["domain", "origin", "family", "length"]
    y, yes = _asked(threshold)
    has = F.col("gold").isNotNull()
    g = df.groupingSets([[n] for n in names], *names).agg(
        *(F.grouping(n).alias(f"_{n}") for n in names),
        F.count("*").alias("n"), F.count_if(has).alias("issue_n"), F.avg(F.when(has, F.col("correct").cast("int"))).alias("issue_accuracy"),
        F.count_if(y & yes).alias("tp"), F.count_if(~y & yes).alias("fp"), F.count_if(y & ~yes).alias("fn"),
    )
    which = F.coalesce(*(F.when(F.col(f"_{n}") == 0, n) for n in names))
    return g.select(which.alias("slice"), F.coalesce(*names).alias("key"), "n", "issue_n", "issue_accuracy", f1(F.col("tp"), F.col("fp"), F.col("fn"))[2].alias("clarification_f1"))


def bias_by_category(df: DataFrame) -> DataFrame:
    """For each category that is gold or predicted: support, predicted, hits, true and predicted share of its domain, their
    ratio (infinite without gold), recall, and the share of it that is predicted as ``other``."""
    some = hard(df)
    counts = M.per_category(some).select("category", "support", "predicted", "hits")
    lost = some.where(F.col("pred").endswith("/other") & ~F.col("gold").endswith("/other")).groupBy(F.col("gold").alias("category")).agg(F.count("*").alias("lost"))
    domain = F.substring_index("category", "/", 1)
    totals = some.groupBy("domain").agg(F.count("*").alias("total"))
    c = counts.join(lost, "category", "left").withColumn("domain", domain).join(F.broadcast(totals), "domain")
    true, pred = F.col("support") / F.col("total"), F.col("predicted") / F.col("total")
    ratio = F.when(F.col("support") > 0, pred / true).when(F.col("predicted") > 0, F.lit(float("inf")))
    return c.select(
        "category", "support", "predicted", "hits", true.alias("true_share"), pred.alias("pred_share"), ratio.alias("share_ratio"),
        M.ratio(F.col("hits"), F.col("support")).alias("recall"), M.ratio(F.coalesce("lost", F.lit(0)), F.col("support")).alias("recall_into_other"),
    )


def bias_verdicts(df: DataFrame) -> DataFrame:
    """``(verdict, passed, value, checked)`` of the five checks. ``passed`` is null where there is nothing to judge;
    ``value`` is the worst one, or the quantity itself."""
    c = bias_by_category(df)
    big = F.col("support") >= SUPPORT
    other = F.col("category").endswith("/other")
    sums = c.agg(
        F.count_if(big).alias("checked"),
        F.max(F.when(big, F.col("share_ratio"))).alias("most"), F.min(F.when(big, F.col("recall"))).alias("least"),
        *(F.coalesce(F.sum(F.when(other, F.col(n))), F.lit(0)).alias(f"o_{n}") for n in ("support", "predicted", "hits")),
    )
    asked = df.where("said IS NOT NULL").agg(F.avg(F.col("asks").cast("int")).alias("true_rate"), F.avg((F.col("said") >= 0.5).cast("int")).alias("said_rate"), F.count("*").alias("asked"))
    one = sums.crossJoin(F.broadcast(asked))  # one row with one row
    col = F.col
    o_ratio = F.when(col("o_support") > 0, col("o_predicted") / col("o_support")).when(col("o_predicted") > 0, F.lit(float("inf")))
    o_precision = M.ratio(col("o_hits"), col("o_predicted"))
    gap = F.abs(col("said_rate") - col("true_rate"))
    row = lambda name, passed, value, n: F.struct(F.lit(name).alias("verdict"), passed.alias("passed"), value.cast("double").alias("value"), n.cast("long").alias("checked"))
    verdicts = F.array(
        row("share_ratio", col("most") <= MOST_SHARE, col("most"), col("checked")),
        row("other_share_ratio", o_ratio <= MOST_SHARE, o_ratio, col("o_support")),
        row("recall", col("least") >= LEAST_RECALL, col("least"), col("checked")),
        row("other_precision", F.when((col("o_predicted") > 0) | (col("o_support") > 0), F.coalesce(o_precision >= LEAST_PRECISION, F.lit(False))), o_precision, col("o_predicted")),
        row("clarify_rate", gap <= MOST_GAP, gap, col("asked")),
    )
    return one.select(F.inline(verdicts))


def worst(categories: DataFrame, n_recall: int = 5, n_leaks: int = 10) -> DataFrame:
    """``(list, place, category, value)``: the lowest recalls of categories with enough support, and the categories that
    ``other`` swallows most of. Ties by name."""

    def top(df: DataFrame, name: str, value: str, n: int, rising: bool) -> DataFrame:
        by = F.col(value).asc() if rising else F.col(value).desc()
        kept = df.orderBy(by, "category").limit(n)
        place = F.row_number().over(Window.orderBy(by, "category"))  # of n rows
        return kept.select(F.lit(name).alias("list"), place.alias("place"), "category", F.col(value).alias("value"))

    low = top(categories.where(F.col("support") >= SUPPORT), "recall", "recall", n_recall, True)
    return low.union(top(categories.where("recall_into_other > 0"), "into_other", "recall_into_other", n_leaks, False))


def best_checkpoint(scores: DataFrame, checkpoint: str, p_gold: str) -> DataFrame:
    """``(checkpoint, nll, best)``: the mean NLL of each checkpoint; the least one is the best, by name on a tie."""
    each = scores.groupBy(checkpoint).agg(F.avg(M.nll(F.col(p_gold))).alias("nll"))
    least = each.agg(F.min(F.struct("nll", checkpoint)).alias("_least"))
    return each.crossJoin(F.broadcast(least)).select(checkpoint, "nll", (F.col("_least")[checkpoint] == F.col(checkpoint)).alias("best"))


def parity(ours: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """One row (n, largest, flips, missing): how far probabilities (arrays ``p``) are from a reference's, and in how many
    rows another option is the likeliest."""
    met = ours.join(reference.select(*keys, F.col("p").alias("_q")), keys, "left")
    gap = F.array_max(F.zip_with("p", "_q", lambda x, y: F.abs(x - y)))
    first = lambda c: F.array_position(c, F.array_max(c))
    has = F.col("_q").isNotNull()
    return met.agg(F.count_if(has).alias("n"), F.max(gap).alias("largest"), F.count_if(has & (first("p") != first("_q"))).alias("flips"), F.count_if(~has).alias("missing"))


def stride(df: DataFrame, line: str, total: int, n: int) -> DataFrame:
    """About n of ``total`` rows at even distances along dense line numbers: the first n of every step-th."""
    step = max(1, total // n)
    return df.where((F.col(line) % step == 0) & (F.col(line) < step * n))


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    """Probabilities of an array of scores."""
    top = F.array_max(scores)
    parts = F.transform(scores, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(parts, lambda x: x / total)


def rescaled(p: Column) -> Column:
    """The confidence of the likeliest option, 0 for a flat distribution and 1 for a certain one, to 4 digits."""
    k = F.size(p)
    return F.round(F.when(k == 1, 1.0).otherwise((F.array_max(p) - 1 / k) / (1 - 1 / k)), 4)


def normalised(v: Column) -> Column:
    """A vector at unit length; a zero vector stays."""
    length = F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x))
    return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(x))


def pooled(rows: DataFrame, key: str, vector: str, weight: str) -> DataFrame:
    """``(key, vector)``: the weighted mean of each key's vectors (token vectors under a mask), component by component."""
    each = rows.where(F.col(weight) > 0).select(key, F.col(weight).alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    means = each.groupBy(key, "_i").agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(vector))
