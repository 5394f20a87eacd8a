"""Line numbers and training requests for exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.hashing import uniform
from granary.operators.workspace import materialize


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Add 0-based line numbers in the order of a column: rows are range-partitioned and sorted, each partition's count
    gives the next one's offset. Only the counts, one for each partition, are brought together."""
    placed = materialize(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + rank - 1)).drop("_part", "_before")


def running(df: DataFrame, order: list[Column], **values: str) -> DataFrame:
    """Add the running sum of each value (a column's name) up to and with each row, in the order given, however many rows
    are equal in part of it: rows are range-partitioned and sorted, each partition's sums give the next one's start."""
    placed = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = placed.groupBy("_part").agg(*(F.sum(c).alias(f"_{n}") for n, c in values.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in values))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = placed.join(F.broadcast(starts), "_part")
    return met.select(*df.columns, *((F.col(f"_{n}") + F.sum(c).over(within)).alias(n) for n, c in values.items()))


def candidates(names: list[str], fallback: str, label: Column, key: Column, seed: str, train: bool, p_drop: float = 0.15) -> Column:
    """The categories a request offers. For evaluation all, in their order. For training shuffled, and with chance
    ``p_drop`` without one to three that are neither the label nor the fallback; never for rows without a label, whose
    target covers all. Every choice is drawn from seed and key, so one row's export never shifts another's."""
    if not train:
        return F.array(*map(F.lit, names))
    drawn = F.array(*(F.struct(uniform(f"{seed}:order", key, F.lit(n)).alias("u"), F.lit(n).alias("c")) for n in names))
    spare = F.array(*(F.struct(uniform(f"{seed}:spare", key, F.lit(n)).alias("u"), F.lit(n).alias("c")) for n in names))
    dropping = label.isNotNull() & (uniform(f"{seed}:drop", key) < p_drop)
    count = F.when(dropping, (1 + F.floor(uniform(f"{seed}:count", key) * 3)).cast("int")).otherwise(0)
    losable = F.filter(F.array_sort(spare), lambda x: (x["c"] != F.lit(fallback)) & (x["c"] != label))
    gone = F.transform(F.when(count > 0, F.slice(losable, F.lit(1), count)).otherwise(F.slice(losable, 1, 0)), lambda x: x["c"])
    return F.array_except(F.transform(F.array_sort(drawn), lambda x: x["c"]), gone)


def wording(variants: int, key: Column, seed: str, train: bool, p_paraphrase: float = 0.5) -> Column:
    """Which wording of a question a request uses: 0, or for training with chance ``p_paraphrase`` another one."""
    if not train or variants < 2:
        return F.lit(0)
    other = (1 + F.floor(uniform(f"{seed}:other", key) * (variants - 1))).cast("int")
    return F.when(uniform(f"{seed}:paraphrase", key) < p_paraphrase, other).otherwise(0)


def request_json(message: Column, offered: Column, criteria: dict[str, str], wordings: tuple[list[str], list[str]], variants: tuple[Column, Column], label: Column, target: Column, needs: Column, yes_no: dict[str, str]) -> Column:
    """A training request as JSON text: the message as state, the choice q1 with its criteria in the order offered, and
    the yes/no question q2. ``target`` (a map) stands for a missing label; its largest entry is then the label."""
    text = F.create_map(*(F.lit(x) for pair in criteria.items() for x in pair))
    options = F.map_from_arrays(offered, F.transform(offered, lambda c: F.element_at(text, c)))
    top = F.array_max(F.map_values(target))
    likeliest = F.get(F.filter(F.map_keys(target), lambda k: F.element_at(target, k) == top), F.lit(0))
    say = lambda texts, v: F.get(F.array(*map(F.lit, texts)), v)
    choice = F.struct(
        F.lit("choice").alias("type"), say(wordings[0], variants[0]).alias("instructions"), options.alias("criteria"),
        F.when(label.isNull(), target).alias("target"), F.coalesce(label, likeliest).alias("label"),
    )
    ask = F.struct(
        F.lit("noul").alias("type"), say(wordings[1], variants[1]).alias("instructions"),
        F.create_map(*(F.lit(x) for pair in yes_no.items() for x in pair)).alias("criteria"), needs.alias("label"),
    )
    return F.to_json(F.struct(message.alias("state"), F.struct(choice.alias("q1"), ask.alias("q2")).alias("questions")))
