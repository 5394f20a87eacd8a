"""Connected components of an edge table, by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.joins import counted_join
from granary.operators.workspace import materialize, release


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Each edge (u, v) with the least of u and all of u's v's. The minimum is combined map-side; the edges of a hub meet
    it where they are."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return counted_join(edges, least.select("u", F.least("u", "m").alias("m"), "n"), "u", "n", total)


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has an edge; ``root`` is the least node of its component.

    Nodes may be of any orderable type; null ends and self-loops are ignored, repeated edges count once. An empty
    edge table gives an empty result. Every round is written to the shared folder and replaces the one before; only two
    numbers per round reach the driver.
    """
    kept = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    # v < u: every edge once, seen from its larger end
    now = materialize(
        kept.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "components"
    )
    before = None
    while (seen := _signature(now)) != before:
        before, last = seen, now
        if not seen[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * seen[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = materialize(large.distinct(), "stars")
        small = _with_least(large, seen[0])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v"))
        )
        now = materialize(small.where("u > v").distinct(), "components")
        release(last, large)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
