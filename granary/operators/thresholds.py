"""The similarity cut-off of a refusal gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_threshold(df: DataFrame, score: str, refuse: str, min_kept: float) -> DataFrame:
    """One row (threshold, kept, refused): among midpoints of adjacent scores that keep at least ``min_kept`` of the
    answerable rows, the one that refuses the most others; ties go to the widest gap, then the higher cut-off.
    Rows are reduced to distinct scores before anything is ordered."""
    counts = df.groupBy(score).agg(F.count_if(~F.col(refuse)).alias("p"), F.count_if(F.col(refuse)).alias("q"))
    order = Window.orderBy(score)
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    c = counts.select(
        F.col(score).alias("s"), F.lag(score).over(order).alias("below"), F.coalesce(F.sum("p").over(upto), F.lit(0)).alias("p0"),
        F.coalesce(F.sum("q").over(upto), F.lit(0)).alias("q0"), F.sum("p").over(everything).alias("pn"), F.sum("q").over(everything).alias("qn"),
    )
    t = F.when(F.col("below").isNull(), F.col("s") - 0.001).otherwise((F.col("below") + F.col("s")) / 2)
    gap = F.round(F.col("s") - F.coalesce("below", F.col("s") - 0.001), 9)
    kept, refused = 1 - F.col("p0") / F.nullif("pn", F.lit(0)), F.col("q0") / F.nullif("qn", F.lit(0))
    scored = c.select(t.alias("threshold"), gap.alias("gap"), kept.alias("kept"), refused.alias("refused")).where(F.col("kept") >= min_kept - 1e-12)
    return scored.orderBy(F.desc("refused"), F.desc("gap"), F.desc("threshold")).limit(1).drop("gap")
