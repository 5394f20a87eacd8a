"""Keyword-rule router: cue scores for each category, smoothed to a distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cue_score(text: Column, cues: list) -> Column:
    """Cues are strings (1 each if contained), lists (1 if all are) or {all, weight}. ``text`` is in lower case."""
    score = F.lit(0.0)
    for cue in cues:
        terms, weight = (cue["all"], cue.get("weight", 1)) if isinstance(cue, dict) else (cue if isinstance(cue, list) else [cue], 1)
        met = F.lit(True)
        for term in terms:
            met = met & F.contains(text, F.lit(term.lower()))
        score = score + F.when(met, float(weight)).otherwise(0.0)
    return score


def route(df: DataFrame, cues: dict[str, list], text_col: str = "text") -> DataFrame:
    """Add scores, p (both in the order of ``cues``), pred, conf, clar and rule.

    No cue: a flat distribution and clarification 0.9. Otherwise scores plus 0.05, normalised; clarification 0.6 on a
    tie for the top, else 0.1. The first of equal categories wins. A null text has no cue.
    """
    names = list(cues)
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn("scores", F.array(*(cue_score(text, cues[c]) for c in names)))
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    ranked = F.sort_array("scores", asc=False)
    tie = F.get(ranked, F.lit(0)) == F.get(ranked, F.lit(1))
    df = df.select("*", total.alias("_total"), tie.alias("_tie"))
    flat = F.transform("scores", lambda s: F.lit(1.0 / len(names)))
    smooth = F.transform("scores", lambda s: (s + 0.05) / (F.col("_total") + 0.05 * len(names)))
    df = df.withColumn("p", F.when(F.col("_total") == 0, flat).otherwise(smooth))
    best = F.array_position("p", F.array_max("p")).cast("int")
    none = F.col("_total") == 0
    return df.select(
        "*",
        F.element_at(F.array(*map(F.lit, names)), best).alias("pred"),
        F.array_max("p").alias("conf"),
        F.when(none, 0.9).when(F.col("_tie"), 0.6).otherwise(0.1).alias("clar"),
        F.when(none, "no cue").when(F.col("_tie"), "tie").otherwise("match").alias("rule"),
    ).drop("_total", "_tie")
