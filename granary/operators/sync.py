"""Content-addressed incremental sync."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan(wanted: DataFrame, stored: DataFrame, key: str, content: str, meta: str) -> DataFrame:
    """``(key, action)``: delete, embed (new or changed content), update (metadata alone) or unchanged."""
    w = wanted.select(F.col(key).alias("wk"), F.col(content).alias("wc"), F.col(meta).alias("wm"))
    s = stored.select(F.col(key).alias("sk"), F.col(content).alias("sc"), F.col(meta).alias("sm"))
    action = (
        F.when(F.col("wk").isNull(), "delete")
        .when(F.col("sk").isNull() | ~F.col("wc").eqNullSafe(F.col("sc")), "embed")
        .when(~F.col("wm").eqNullSafe(F.col("sm")), "update")
        .otherwise("unchanged")
    )
    return w.join(s, F.col("wk") == F.col("sk"), "full").select(F.coalesce("wk", "sk").alias(key), action.alias("action"))
