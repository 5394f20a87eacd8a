"""Quality rules (operator 6): heuristic counts, and the log-likelihood ratio of hashed n-grams between a trusted target and
the raw corpus, length-normalised and thresholded. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.workspace import materialize

#: Buckets of the multinomials: the weight table is broadcast, so this bounds its size.
BUCKETS = 1 << 16
#: Labelled rows of the trusted target at most, those with the least hash of their id.
TARGET_ROWS = 20_000
#: Least mean log-likelihood ratio of a kept document.
THRESHOLD = -0.25
#: Weights are summed as whole multiples of this, so sums do not depend on their order.
UNIT = 1e-6
SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"


def _stages(df: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    """Add columns step by step; a later step sees the earlier ones' results instead of recomputing them."""
    for step in steps:
        df = df.select("*", *(c.alias(name) for name, c in step.items()))
    return df


def rule_counts(rows: DataFrame, text: str) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the text column, which must not be null."""
    t = F.col(text)
    n = F.col("n_words")
    windows = F.transform(
        F.sequence(F.lit(0), n.cast("int") - 3),
        lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(x: Column, k: Column) -> Column:
        beside = lambda j: F.coalesce(F.get("_placed", j)["h"] == x["h"], F.lit(False))
        return beside(k - 1) | beside(k + 1)

    starts = F.sort_array(F.transform(F.filter("_placed", twice), lambda x: x["i"]))
    covered = F.transform("_starts", lambda s, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - s, F.lit(3))))
    return _stages(
        rows,
        {
            "_words": F.array_remove(F.split(t, SPACE), ""),
            "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        },
        {
            "n_words": F.size("_words").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        },
        {"_windows": F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>"))},
        {"_sorted": F.sort_array("_windows")},
        {"_repeats": F.exists(F.transform("_sorted", lambda x, i: (i > 0) & (x == F.get("_sorted", i - 1))), lambda x: x)},
        {"_placed": F.when(F.col("_repeats"), placed)},
        {"_starts": F.when(F.col("_repeats"), starts)},
        {"n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")},
    ).drop("_words", "_lines", "_windows", "_sorted", "_repeats", "_placed", "_starts")


def _grams(rows: DataFrame, text: str, outer: bool = False) -> DataFrame:
    """A row for each n-gram: bucket of the token (runs of letters and digits, or of other characters), and of the token
    with the one after it."""
    tokens = F.regexp_extract_all(F.col(text), F.lit("[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]+"), F.lit(0))
    explode = F.posexplode_outer if outer else F.posexplode
    placed = rows.select("*", tokens.alias("_tokens")).drop(text)
    placed = placed.select(*(c for c in placed.columns if c != "_tokens"), "_tokens", explode("_tokens").alias("_at", "_token"))
    following = F.get("_tokens", F.col("_at") + 1)
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BUCKETS)).cast("int")
    grams = F.array(bucket(F.col("_token")), bucket(F.col("_token"), F.coalesce(following, F.lit(""))))
    kept = [c for c in placed.columns if c not in ("_tokens", "_at", "_token")]
    return placed.select(*kept, "_at", explode(F.when(F.col("_token").isNotNull(), grams)).alias("_order", "_bucket"))


def fit_weights(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``(_bucket, weight)``: the log ratio of target to raw probability, in UNITs, for each bucket seen in the corpus.

    The raw counts cover every row of ``docs``; the target is the rows that carry a label of 1, TARGET_ROWS at most.
    Both counts are smoothed by one per bucket.
    """
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct()
    trusted = trusted.orderBy(F.xxhash64("_id"), "_id").limit(TARGET_ROWS).select("_id", F.lit(1).alias("_target"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.join(F.broadcast(trusted), "_id", "left").select("_text", F.coalesce("_target", F.lit(0)).alias("_target"))
    counts = materialize(
        _grams(rows, "_text").groupBy("_bucket").agg(F.count("*").alias("raw"), F.sum("_target").alias("target")), "grams"
    )
    total = counts.agg(F.sum("raw"), F.sum("target")).first()
    raw, target = (total[0] or 0) + BUCKETS, (total[1] or 0) + BUCKETS
    ratio = F.log((F.col("target") + 1) / F.lit(float(target))) - F.log((F.col("raw") + 1) / F.lit(float(raw)))
    return counts.select("_bucket", F.round(ratio / UNIT).cast("long").alias("weight"))


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score)`` of every row.

    ``score`` is the mean weight of the document's n-grams (null without any). ``base_failed``: fewer than 50 words or
    over half of them in repeated three-word windows. ``kept``: not failed and a score of ``threshold`` or more. Null
    and empty texts have no words and fail. Null ids are rows like others, repeated rows repeat, an empty table gives
    an empty result, and without labels the target is flat. Other columns are not read. Only two sums reach the driver;
    the broadcast tables are bounded by TARGET_ROWS and BUCKETS. N-grams are counted and summed before any shuffle.
    """
    weights = fit_weights(docs, labels, id_col, text_col, label_col)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rule_counts(rows, "_text").withColumn("_hash", F.xxhash64("_text"))
    grams = _grams(rows.select("_id", "_hash", *counts, "_text"), "_text", outer=True)
    scored = (
        grams.join(F.broadcast(weights), "_bucket", "left")
        .groupBy("_id", "_hash", *counts)
        .agg(
            F.sum("weight").alias("total"),
            F.count("weight").alias("n"),
            F.count_if((F.coalesce("_at", F.lit(0)) == 0) & (F.coalesce("_order", F.lit(0)) == 0)).alias("copies"),
        )
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    score = F.when(F.col("n") > 0, F.col("total") / F.col("n") * UNIT)
    return scored.select(
        F.col("_id").alias(id_col),
        *counts,
        failed.alias("base_failed"),
        (~failed & (F.coalesce(score, F.lit(-math.inf)) >= threshold)).alias("kept"),
        F.round(score, 6).alias("score"),
    )
