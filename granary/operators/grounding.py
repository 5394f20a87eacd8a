"""Which quotes stand verbatim in which texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import collapse

#: Characters by which quotes without an inner word are found.
SHORT = 3


def _grams(text: Column, n: int) -> Column:
    """The distinct substrings of n characters."""
    at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(n))))


def verbatim(quotes: DataFrame, quote_id: str, texts: DataFrame, text_id: str, text_col: str = "text") -> DataFrame:
    """``(quote_id, text_id)`` where a white-space-collapsed quote is part of a text; empty quotes never are.

    A quote's longest inner word must be a word of the text, so the join is on that word and containment is checked on
    the pairs it leaves. The ends of a quote may lie within words, so quotes of one or two words have no inner word; they
    meet the texts through their first SHORT characters, which are one of the text's distinct substrings of that length.
    """
    q = quotes.select(F.col(quote_id).alias("qid"), collapse(F.col(text_col)).alias("qt")).where("qt <> ''")
    t = texts.select(F.col(text_id).alias("tid"), collapse(F.col(text_col)).alias("tt"))
    inner = F.slice(F.split("qt", " "), F.lit(2), F.greatest(F.size(F.split("qt", " ")) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = q.withColumn("w", longest)
    # only ids and words are shuffled; texts are fetched for the pairs that are left
    words = t.select("tid", F.explode(F.array_distinct(F.split("tt", " "))).alias("w"))
    met = words.join(keyed.where("w IS NOT NULL").select("qid", "w"), "w").select("qid", "tid")
    brief = keyed.where("w IS NULL").withColumn("w", F.substr("qt", F.lit(1), F.lit(SHORT)))
    grams = F.flatten(F.array(*(_grams(F.col("tt"), n) for n in range(1, SHORT + 1))))
    short = t.select("tid", F.explode(grams).alias("w")).join(brief.select("qid", "w"), "w").select("qid", "tid")
    pairs = met.union(short).distinct().join(q, "qid").join(t, "tid").where(F.contains("tt", "qt"))
    return pairs.select("qid", "tid").distinct().select(F.col("qid").alias(quote_id), F.col("tid").alias(text_id))
