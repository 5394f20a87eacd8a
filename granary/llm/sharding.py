"""Sharding (operator 9): size-weighted key samples give splitters, records are range-partitioned by them, and ranges that
hold more than a shard's share are subdivided by their running sizes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.workspace import materialize

#: Ranges that the splitters cut for each shard, and sampled keys for each range.
RANGES, SAMPLES = 6, 40
#: Rows of a range above which all ranges are cut further, and the number of ranges that this leads to at most.
RANGE_ROWS, MOST_RANGES = 50_000, 100_000


def _below(splitters: list[tuple[int, int]], hashed: Column, tie: Column) -> Column:
    """The number of splitters at or below a key: a balanced tree of comparisons, so log2 of their number per row."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        h, t = splitters[mid]
        before = (hashed < F.lit(h)) | ((hashed == F.lit(h)) & (tie < F.lit(t)))
        return F.when(before, tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(splitters))


def _within(splitters: list[tuple[int, int]], parts: int) -> Column:
    """Which of ``parts`` equal slices of its range (``_range``) a key is in: slices of the hash, or of the tie where a range
    holds one hash. Keys in order have slices in order."""
    low, high = (-(1 << 63), -(1 << 63)), ((1 << 63) - 1, (1 << 63) - 1)
    ends = [low, *splitters, high]
    end = lambda k, shift: F.get(F.array(*(F.lit(x[k]) for x in ends)), F.col("_range") + shift).cast("double")

    def slice_of(column: str, k: int) -> Column:
        a, b = end(k, 0), end(k, 1)
        return F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor((F.col(column).cast("double") - a) / (b - a) * parts))).cast("int")

    same = F.get(F.array(*(F.lit(x[0]) for x in ends)), F.col("_range")) == F.get(F.array(*(F.lit(x[0]) for x in ends)), F.col("_range") + 1)
    return F.when(same, F.coalesce(F.when(end(1, 0) < end(1, 1), slice_of("_tie", 1)), F.lit(0))).otherwise(F.when(end(0, 0) < end(0, 1), slice_of("_h", 0)).otherwise(0))


def shard_by_bytes(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16
) -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)`` of every row; the law is `bytes`.

    ``size`` is the UTF-8 length of the text (null: none) plus ``overhead``. Rows are ordered by a hash of their text and
    then by their id, so equal texts stay together unless a shard's end falls among them; a shard takes the rows whose
    middle byte falls in its equal part of all bytes, so two shards differ by two row sizes at most. ``slot`` counts a
    shard's rows from 0. Null ids are rows like others. Repeated rows (same id and text) are interchangeable. An empty
    table gives an empty result. A very long text is one row: a shard's bytes miss their share by its size at most. Other
    columns are not read. Only counts per range and the bounded sample reach
    the driver.
    """
    text = F.col(text_col)
    keyed = materialize(
        docs.select(
            F.col(id_col),
            (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h"),
            F.xxhash64(F.col(id_col)).alias("_tie"),
        ),
        "sizes",
    )
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = shards * RANGES
    # a key is drawn with probability size * rate, by a hash of its own: the expected sample is bounded
    rate = ranges * SAMPLES / max(total, 1)
    draw = F.pmod(F.xxhash64(F.lit(7), "_h", "_tie"), F.lit(1 << 30)) / float(1 << 30)
    drawn = keyed.where(draw < F.col("size") * F.lit(rate)).select("_h", "_tie").limit(4 * ranges * SAMPLES)
    sample = sorted((r["_h"], r["_tie"]) for r in drawn.collect())
    cuts = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    parts = min(-(-rows // (RANGE_ROWS * ranges)), MOST_RANGES // ranges) or 1
    ranged = keyed.withColumn("_range", _below(cuts, F.col("_h"), F.col("_tie")))
    if parts > 1:
        ranged = ranged.withColumn("_range", F.col("_range") * parts + _within(cuts, parts))
    sums = ranged.groupBy("_range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    offsets, bytes_before, rows_before = [], 0, 0
    for r in sorted(sums, key=lambda r: r["_range"]):
        offsets.append((r["_range"], bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + r["bytes"], rows_before + r["rows"]
    start = docs.sparkSession.createDataFrame(offsets, "_range int, _bytes long, _rows long")
    within = Window.partitionBy("_range").orderBy("_h", "_tie", F.col(id_col), "size")
    placed = (
        ranged.withColumn("_upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_rank", F.row_number().over(within))
        .join(F.broadcast(start), "_range")
    )
    middle = (F.col("_bytes") + F.col("_upto")) * 2 - F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / F.lit(max(2 * total, 1)).cast("decimal(20,0)")))
    placed = placed.select(
        id_col, "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("_rows") + F.col("_rank") - 1).alias("_row")
    )
    placed = materialize(placed, "shards")
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        id_col,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_row") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
