"""Benchmark decontamination (operator 8): each item window is looked up by its rarest shingle (the prefix that exact
containment needs), bounded by position and length, and verified word by word. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.workspace import materialize

#: Consecutive words of a window; shorter items are one window.
WINDOW = 8
#: Rows of a benchmark table that are broadcast at once; larger tables take several passes over the documents.
BROADCAST_ROWS = 500_000
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """A-Z lower-cased, then runs of ASCII letters and digits and of other alphabets' characters; null has none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _shingle(array: str, at: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(array, at + k) for k in range(size)))


def _windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``(item, iw, n, text, size, first)``: an item's words, their number and hash, the length of its windows and each
    window's place. An item's id may occur with several texts: item and text together tell them apart."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("iw"))
    items = items.select("item", "iw", F.size("iw").alias("n")).where("n > 0").distinct()
    return items.select(
        "*",
        F.xxhash64("iw").alias("text"),
        F.least("n", F.lit(WINDOW)).alias("size"),
        F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - WINDOW, F.lit(0)))).alias("first"),
    )


def _parts(table: DataFrame, key: str) -> list[DataFrame]:
    """``table`` in parts that are each small enough to broadcast."""
    n = math.ceil(table.count() / BROADCAST_ROWS)
    return [table.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def _shingles(docs: DataFrame, size: int, *carried: str) -> DataFrame:
    """A row for each shingle of a document: its hash and place, with the document's words at hand."""
    placed = docs.select(*carried, "dw", F.posexplode("dw").alias("at", "_word"))
    return placed.where(F.col("at") + size <= F.size("dw")).withColumn("h", _shingle("dw", F.col("at"), size))


def _rarities(docs: DataFrame, shingles: DataFrame, size: int) -> DataFrame:
    """``(h, seen)``: how often each of the benchmark's shingles occurs in all documents."""
    found = None
    for part in _parts(shingles.select("h").distinct(), "h"):
        counts = _shingles(docs, size).join(F.broadcast(part), "h").groupBy("h").agg(F.count("*").alias("seen"))
        counts = materialize(counts, "rarity")
        found = counts if found is None else found.union(counts)
    return found


def _anchors(docs: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """Windows gathered by the shingle that finds them: ``(h, offset, item, iw, size, low, high)`` says that shingle h at
    word ``offset`` of the item leads to the windows that start at words low to high.

    A window's shingles are ordered by rarity over all documents; containment is total, so the first one alone is its
    prefix. A shingle that no document has rules its window out."""
    shingled = windows.withColumn("offset", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("size") - size)))
    shingled = materialize(shingled.withColumn("h", _shingle("iw", F.col("offset"), size)), "windows")
    rarity = _rarities(docs, shingled, size)
    if rarity is None:
        return None
    ranked = shingled.join(rarity, "h", "left").groupBy("item", "text", "size", "first").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "h", "offset")).alias("rarest"), F.first("iw").alias("iw")
    )
    gathered = ranked.where("rarest.seen > 0").groupBy("rarest.h", "rarest.offset", "item", "text", "size").agg(
        F.min("first").alias("low"), F.max("first").alias("high"), F.first("iw").alias("iw")
    )
    return materialize(gathered, "anchors")


def _occurrences(docs: DataFrame, anchors: DataFrame, size: int) -> DataFrame:
    """``(_id, _hash, item, s)``: for each document and anchor met, the verified windows s as (start, end) word places."""
    start = F.col("at") - F.col("offset")
    # a window must lie within the document: positions bound its start, lengths its end
    low = F.greatest(F.col("low"), -start)
    high = F.least(F.col("high"), F.size("dw") - F.col("size") - start)

    def same(i: Column) -> Column:
        return F.slice("dw", start + i + 1, F.col("size")) == F.slice("iw", i + 1, F.col("size"))

    def span(i: Column) -> Column:
        return F.struct((start + i).alias("start"), (start + i + F.col("size")).alias("end"))

    # conditions on both sides would enter the join and take it, with every word's copy of its document, out of codegen
    spans = F.when(low <= high, F.transform(F.filter(F.sequence(low, high), same), span))
    out = None
    for part in _parts(anchors, "h"):
        met = _shingles(docs, size, "_id", "_hash").join(F.broadcast(part), "h")
        found = met.select("_id", "_hash", "item", F.explode_outer(spans).alias("s")).where("s IS NOT NULL")
        out = found if out is None else out.union(found)
    return out


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least_items: int = 2,
) -> DataFrame:
    """``(id, n_words, n_hit, n_items, items_sha256, contaminated)`` of every row of ``docs``.

    A word is hit if a window of WINDOW consecutive words of an item, or the whole of a shorter item, occurs there;
    ``contaminated`` is n_items >= least_items. Null and empty texts have no words; items without words or without an id
    are left out; equal items with different ids all count. Rows that repeat an id and text all get the same result.
    Null ids are rows like others. An empty table on either side gives no hits. Other columns are not read.

    Documents are never shuffled: benchmark tables are broadcast in parts of BROADCAST_ROWS, and only verified
    occurrences are grouped, by document.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_hash"), words(text).alias("dw")
    )
    windows = materialize(_windows(benchmark, item_col, item_text_col), "items")
    found = None
    for size in (2, 1):
        sized = windows.where(F.col("size") > 1 if size == 2 else F.col("size") == 1)
        anchors = _anchors(rows, sized, size) if sized.limit(1).count() else None
        part = None if anchors is None else _occurrences(rows, anchors, size)
        found = part if found is None else found if part is None else found.union(part)
    base = rows.select("_id", "_hash", F.size("dw").cast("long").alias("n_words"))
    none = F.sha2(F.lit(""), 256)
    if found is None:
        joined = base.select("*", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items"))
    else:
        by_doc = found.groupBy("_id", "_hash").agg(
            F.array_sort(F.collect_set("s")).alias("spans"),
            F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("ids"),
        )
        reach = F.aggregate(
            "spans",
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
            lambda a, s: F.struct(
                (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).alias("n"),
                F.greatest(a["to"], s["end"]).alias("to"),
            ),
        )
        hits = by_doc.select(
            F.col("_id").alias("_hit_id"),
            F.col("_hash").alias("_hit_hash"),
            reach["n"].alias("hit"),
            F.size("ids").cast("long").alias("n"),
            F.sha2(F.array_join("ids", ","), 256).alias("items"),
        )
        joined = base.join(hits, F.col("_id").eqNullSafe(F.col("_hit_id")) & (F.col("_hash") == F.col("_hit_hash")), "left")
        joined = joined.select(
            "_id", "n_words", F.coalesce("hit", F.lit(0)).alias("n_hit"), F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce("items", none).alias("items")
        )
    return joined.select(
        F.col("_id").alias(id_col),
        "n_words",
        "n_hit",
        "n_items",
        F.col("items").alias("items_sha256"),
        (F.col("n_items") >= least_items).alias("contaminated"),
    )
