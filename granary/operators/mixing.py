"""The training mix: clean records split by cluster, outside records where they are told to go, style variants with their
group."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.dedup import duplicate_clusters
from granary.operators.exporting import numbered
from granary.operators.splits import SPLITS, assign
from granary.operators.validation import origin
from granary.operators.workspace import materialize
from granary.sources.jsonlines import file_digests, write_lines

#: Splits that outside records may be put into.
OPEN = ("train", "dev", "calib")
RANK = {"clean": 0, "external": 1, "realstyle": 2}


def build_splits(clean: DataFrame, realstyle: DataFrame, external: Mapping[str, DataFrame], order: str, seed: str, text_col: str = "message") -> tuple[DataFrame, DataFrame]:
    """``(placed, unplaced)``. ``placed`` has all records of the mix with ``split``, ``part`` (clean, external, realstyle)
    and ``place``, their number within the split: clean records in the order of a column, then external, then style
    variants. ``unplaced`` are style variants whose group no clean record has."""
    if wrong := sorted(set(external) - set(OPEN)):
        raise ValueError(f"outside records do not go to {wrong}, only to {list(OPEN)}")
    group = "scenario_group_id"
    clusters = duplicate_clusters(clean, order, group, text_col)
    of_group = materialize(assign(clusters, "cluster", seed).select(group, "split"), "splits")
    parts = [clean.join(of_group, group).withColumn("part", F.lit("clean"))]
    parts += [df.withColumn("split", F.lit(name)).withColumn("part", F.lit("external")) for name, df in external.items()]
    variants = realstyle.join(of_group, group, "left")
    parts.append(variants.where("split IS NOT NULL").withColumn("part", F.lit("realstyle")))
    columns = [*clean.columns, "split", "part"]
    mixed = parts[0].select(columns)
    for p in parts[1:]:
        mixed = mixed.unionByName(p.select(columns))
    names = [name for name, _ in SPLITS]
    rank = lambda c, values: F.array_position(F.array(*map(F.lit, values)), F.col(c))
    key = F.struct(rank("split", names).alias("s"), rank("part", list(RANK)).alias("p"), F.col(order).alias("o"))
    lined = numbered(mixed.withColumn("_key", key), "_key", "_line").drop("_key")
    starts = lined.groupBy("split").agg(F.min("_line").alias("_first"))
    placed = lined.join(F.broadcast(starts), "split").withColumn("place", F.col("_line") - F.col("_first")).drop("_line", "_first")
    return placed, variants.where("split IS NULL").drop("split")


def split_summary(placed: DataFrame) -> DataFrame:
    """``(split, section, key, n)``: records, groups and scenarios of each split, and its records by script, domain, origin
    and clarification."""
    what = lambda section, key, value=None: F.struct(F.lit(section).alias("section"), key.alias("key"), (F.lit(None).cast("string") if value is None else value).alias("value"))
    entries = F.array(
        what("records", F.lit("all")),
        what("script", F.coalesce("script", F.lit("(none)"))),
        what("domain", F.col("domain")),
        what("origin", origin()),
        what("clarification", F.col("labels.clarification_needed").cast("string")),
    )
    counted = placed.select("split", F.explode(entries).alias("e")).groupBy("split", "e.section", "e.key").agg(F.count("*").alias("n"))
    distinct = placed.groupBy("split").agg(F.count_distinct("scenario_group_id").alias("groups"), F.count_distinct("scenario_id").alias("scenarios"))
    return counted.unionByName(distinct.unpivot("split", ["groups", "scenarios"], "section", "n").select("split", F.lit("distinct").alias("section"), F.col("section").alias("key"), "n"))


def label_shares(records: DataFrame, digits: int = 4) -> DataFrame:
    """``(domain, issue, n, share)``: each hard label's share of its domain's hard-labelled records."""
    hard = records.where("labels.issue IS NOT NULL")
    counts = hard.groupBy("domain", F.col("labels.issue").alias("issue")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("domain").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "domain").select("domain", "issue", "n", F.round(F.col("n") / F.col("total"), digits).alias("share"))


def share_range(shares: DataFrame) -> DataFrame:
    """``(domain, least, most)`` of each domain's label shares."""
    return shares.groupBy("domain").agg(F.min("share").alias("least"), F.max("share").alias("most"))


def leaks(placed: DataFrame, key: str) -> DataFrame:
    """Keys that occur in more than one split, with those splits."""
    return placed.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def write_splits(placed: DataFrame, unplaced: DataFrame, inputs: Mapping[str, str], seed: str, path: str) -> dict:
    """Write each split's records as JSON lines in order, and the manifest: input digests, seed, counts, unplaced records,
    leaks and label shares. Returns the manifest."""
    spark = placed.sparkSession
    kept = materialize(placed, "mix")
    counts = {}
    for name, _ in SPLITS:
        rows = kept.where(F.col("split") == name).repartitionByRange("place").sortWithinPartitions("place")
        counts[name] = write_lines(rows.drop("split", "part", "place"), f"{path}/{name}")
    shares = label_shares(kept.where("split = 'train'"))
    origins = kept.groupBy("split", origin().alias("origin")).agg(F.count("*").alias("n")).collect()
    manifest = {
        "inputs": {n: sorted(r["sha256"] for r in file_digests(spark, p).collect()) for n, p in inputs.items()},
        "seed": seed,
        "splits": {n: {"records": c, "by_origin": {r["origin"]: r["n"] for r in origins if r["split"] == n}} for n, c in counts.items()},
        "unplaced": unplaced.count(),
        "leaking_groups": leaks(kept, "scenario_group_id").count(),
        "leaking_texts": leaks(kept, "content_hash").count() if "content_hash" in kept.columns else None,
        "train_label_shares": {r["domain"]: [r["least"], r["most"]] for r in share_range(shares).collect()},
    }
    text = json.dumps(manifest, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest
