"""Exact and near duplicates of normalised texts, and the clusters they form."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import normalize
from granary.operators.components import connected_components
from granary.operators.joins import salted_join
from granary.operators.workspace import TEXTS, materialize, release

SHINGLE = 5
#: Members of a band that are paired with as many others at once, and texts of a cell, about.
TILE, CELL = 512, 64


def exact_duplicates(df: DataFrame, order: str, group: str, text_col: str = "text") -> DataFrame:
    """``(order, duplicate_of)`` of rows whose normalised text occurs earlier in another group."""
    hashed = materialize(df.select(order, group, F.sha2(normalize(F.col(text_col)), 256).alias("h")), "hashes", TEXTS)
    first = hashed.groupBy("h").agg(F.min_by(F.struct(order, group), order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = salted_join(hashed, first, "h", order).where((F.col("first")[order] < F.col(order)) & (F.col("first")[group] != F.col(group)))
    return met.select(order, F.col("first")[order].alias("duplicate_of"))


class Bands(NamedTuple):
    """How texts of ``least`` to ``most`` distinct shingles are banded: signatures of ``rows`` times ``count`` values, the least
    ones of seeded multiply-add permutations within each of ``bins`` parts of the hashes. Similar texts share a band but for
    one pair in a million at similarity 0.85. The larger sets are, the more unrelated ones have in common, so the more rows
    their bands need; the number of bands follows from it, and grows slower than the texts."""

    least: int
    most: float
    rows: int
    count: int
    bins: int


#: A set near the end of a range is banded for both, so that all sets of similar sizes meet.
RANGES = (Bands(1, 256, 8, 44, 1), Bands(215, 1_024, 10, 72, 16), Bands(868, 4_096, 12, 96, 32), Bands(3_478, float("inf"), 16, 192, 64))


def _keys(h: np.ndarray, b: Bands) -> np.ndarray:
    """A 64-bit key of each band of a set, given as its sorted hashes."""
    made = b.rows * b.count // b.bins
    draw = np.random.default_rng(12345 + b.rows)
    mul = draw.integers(1, 1 << 63, made, np.uint64) | np.uint64(1)
    add = draw.integers(0, 1 << 63, made, np.uint64)
    starts = np.zeros(1, np.int64)
    if b.bins > 1:
        edges = np.arange(b.bins, dtype=np.uint64) << np.uint64(64 - (b.bins - 1).bit_length())
        starts = np.minimum(np.searchsorted(h, edges), len(h) - 1)
    step = max(1, 65_536 // len(h))
    with np.errstate(over="ignore"):
        least = [np.minimum.reduceat(mul[i : i + step, None] * h + add[i : i + step, None], starts, axis=1) for i in range(0, made, step)]
        rows = np.concatenate(least).reshape(b.count, b.rows)
        # a band's key tells its range and its place too
        key = np.arange(b.count, dtype=np.uint64) + np.uint64(b.rows << 32)
        for k in range(b.rows):
            key = (key ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _hashes(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = max(1, len(codes) - SHINGLE + 1)
    h = np.full(n, 1469598103934665603, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(SHINGLE, len(codes))):
            h = (h ^ codes[k : k + n]) * np.uint64(1099511628211)
            h ^= h >> np.uint64(29)
        # bins are by the highest bits, so these are mixed once more
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h)


@F.arrow_udf(T.StructType().add("keys", T.ArrayType(T.LongType())).add("n", T.LongType()))
def _bands(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Band keys of a text's MinHash signatures, and the number of its distinct shingles."""
    for texts in batches:
        out, ends, sizes = [np.zeros(0, np.int64)], [0], []
        for text in texts:
            h = _hashes(text.as_py())
            found = [_keys(h, b) for b in RANGES if b.least <= len(h) <= b.most]
            out += found
            ends.append(ends[-1] + sum(map(len, found)))
            sizes.append(len(h))
        keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out)))
        yield pa.StructArray.from_arrays([keys, pa.array(sizes, pa.int64())], ["keys", "n"])


class _Shingles:
    """Sorted distinct shingles of texts as integers: exact, for code points get dense numbers in the order they are met.
    A text with characters beyond the room for them has none, and its pairs are compared as sets of strings."""

    ROOM, HELD = 6_000, 4_000_000  # ROOM ** SHINGLE fits 63 bits; integers held at most before the store is emptied

    def __init__(self) -> None:
        self.number = np.zeros(0x110000, np.int64)
        self.met = self.held = 0
        self.store: dict[str, np.ndarray | None] = {}

    def of(self, text: str) -> np.ndarray | None:
        if text in self.store:
            return self.store[text]
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        fresh = np.unique(points[self.number[points] == 0])
        found = None
        if self.met + len(fresh) < self.ROOM:
            self.number[fresh] = np.arange(self.met + 1, self.met + 1 + len(fresh))
            self.met += len(fresh)
            digits = self.number[points]
            found = np.zeros(max(1, len(digits) - SHINGLE + 1), np.int64)
            for k in range(min(SHINGLE, len(digits))):
                found = found * self.ROOM + digits[k : k + len(found)]
            found = np.unique(found)
        if self.held > self.HELD:
            self.store, self.held = {}, 0
        self.store[text] = found
        self.held += 0 if found is None else len(found)
        return found


def jaccard_of(left: str, right: str, known: _Shingles) -> float:
    """Jaccard similarity of two texts' character shingles; a text shorter than a shingle is one shingle."""
    a, b = known.of(left), known.of(right)
    if a is None or b is None:
        a, b = ({t[i : i + SHINGLE] for i in range(max(1, len(t) - SHINGLE + 1))} for t in (left, right))
        both = len(a & b)
    else:
        both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """``(ha, hb, jaccard)`` of the similar pairs in cells. Rows ``(cell, k, h, t, partners)`` come cell by cell; a text is
    compared with those of its cell whose ``k`` is among its partners."""
    known, cell, texts, asked = _Shingles(), None, {}, []

    def flush() -> pa.RecordBatch:
        ha, hb, js = [], [], []
        for h, t, partners in asked:
            for p in partners:
                for g, other in texts[p]:
                    j = jaccard_of(t, other, known)
                    if j >= threshold:
                        ha.append(min(h, g))
                        hb.append(max(h, g))
                        js.append(j)
        return pa.RecordBatch.from_arrays([pa.array(ha, pa.string()), pa.array(hb, pa.string()), pa.array(js, pa.float64())], ["ha", "hb", "jaccard"])

    for batch in batches:
        for i in range(batch.num_rows):
            here, k, h, t, partners = (batch.column(c)[i].as_py() for c in ("cell", "k", "h", "t", "partners"))
            if here != cell:
                if asked:
                    yield flush()
                cell, texts, asked = here, {}, []
            texts.setdefault(k, []).append((h, t))
            if partners:
                asked.append((h, t, partners))
    if asked:
        yield flush()


def _rows(df: DataFrame, order: str, group: str, text_col: str) -> DataFrame:
    """``(id, g, t, h)``: each row with its normalised text and that text's hash. Null texts are no one's duplicates."""
    rows = df.select(F.col(order).alias("id"), F.col(group).alias("g"), normalize(F.col(text_col)).alias("t"))
    return materialize(rows.where("t IS NOT NULL").withColumn("h", F.sha2("t", 256)), "texts", TEXTS)


def _candidates(texts: DataFrame, threshold: float) -> DataFrame:
    """``(ka, kb)``, ka < kb, of texts ``(k, t)`` that share a band and whose numbers of shingles allow the similarity, once
    each. The members of a band are taken in tiles, so no task makes all pairs of a common one."""
    signed = texts.select("k", _bands("t").alias("m")).select("k", F.col("m.n").cast("int").alias("n"), F.explode("m.keys").alias("key"))
    shared = signed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "k"))).alias("m")).where(F.size("m") > 1)
    shared = materialize(shared.select("m"), "bands", TEXTS)
    parts = F.ceil(F.size("m") / TILE).cast("int")
    tile = lambda i: F.slice("m", F.col(i) * TILE + 1, TILE)
    tiles = shared.withColumn("i", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("j", F.explode(F.sequence(F.col("i"), parts - 1)))
    tiles = tiles.select(tile("i").alias("left"), tile("j").alias("right"), (F.col("i") == F.col("j")).alias("same"))
    # sizes ascend, so a tile whose least is too large for the other's most has no pairs; the one allows for equal hashes
    near = lambda small, large: small + 1 >= threshold * large
    tiles = tiles.where(near(F.element_at("left", -1)["n"], F.element_at("right", 1)["n"]))
    tiles = tiles.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = tiles.select(F.explode("left").alias("l"), "right", "same").select("l", F.explode("right").alias("r"), "same")
    once = F.when(F.col("same"), F.col("l.k") < F.col("r.k")).otherwise(F.col("l.k") != F.col("r.k"))
    pairs = pairs.where(once & near(F.least("l.n", "r.n"), F.greatest("l.n", "r.n")))
    pairs = materialize(pairs.select(F.least("l.k", "r.k").alias("ka"), F.greatest("l.k", "r.k").alias("kb")).distinct(), "candidates")
    release(shared)
    return pairs


def similar_texts(texts: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``(ha, hb, jaccard)``, ha < hb, of the similar ones among distinct texts ``(h, t)``: MinHash bands propose, the
    exact similarity of the shingle sets decides.

    Texts do not travel with each of their pairs. Candidates that are close to each other fall into one cell by the least
    text that either meets, and a text is sent once to each cell that it has a pair in; cells of many texts are cut.
    """
    # two texts of one number are both compared with what either meets
    texts = materialize(texts.select("h", "t", F.xxhash64("h").alias("k")), "distinct")
    pairs = _candidates(texts, threshold)
    ends = pairs.select(F.col("ka").alias("k"), F.col("kb").alias("o")).union(pairs.select("kb", "ka"))
    label = ends.groupBy("k").agg(F.min("o").alias("o")).select("k", F.least("k", "o").alias("label"))
    sizes = label.groupBy("label").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("k"), F.ceil(F.col("n") / CELL))
    label = materialize(salted_join(label, sizes, "label", "k").select("k", F.struct("label", part.alias("part")).alias("c")), "labels")
    of = lambda side: label.select(F.col("k").alias(f"k{side}"), F.col("c").alias(f"c{side}"))
    dealt = pairs.join(of("a"), "ka").join(of("b"), "kb").select(F.xxhash64(F.least("ca", "cb"), F.greatest("ca", "cb")).alias("cell"), "ka", "kb")
    asked = dealt.select("cell", F.col("ka").alias("k"), F.col("kb").alias("p")).union(dealt.select("cell", "kb", F.lit(None).cast("long")))
    asked = materialize(asked.groupBy("cell", "k").agg(F.collect_list("p").alias("partners")), "asked")
    met = asked.join(texts, "k").select("cell", "k", "h", "t", "partners")
    # few bytes, much work: a number of tasks that is not coalesced by size
    met = met.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell")
    found = met.mapInArrow(lambda batches: _verified(batches, threshold), "ha string, hb string, jaccard double")
    found = materialize(found, "similar", TEXTS)
    release(texts, pairs, label, asked)
    return found


def near_pairs(df: DataFrame, order: str, group: str, text_col: str = "text", threshold: float = 0.85) -> DataFrame:
    """``(a, b, jaccard, kind)``, a < b: how rows with similar normalised texts hang together.

    Rows of equal texts form a class, which its least row stands for. ``copy`` rows link that one to each other member;
    ``similar`` rows link the least rows of two classes, unless all rows of both are of one group. Every pair of similar
    rows follows from these, but a class of n copies gives n - 1 rows, not n * n.
    """
    rows = _rows(df, order, group, text_col)
    lead = rows.groupBy("h").agg(F.min("id").alias("rep"), F.min("g").alias("low"), F.max("g").alias("high"), F.count("*").alias("n"))
    lead = materialize(lead, "classes")
    similar = similar_texts(rows.groupBy("h").agg(F.first("t").alias("t")), threshold)
    of = lambda side: lead.select(*(F.col(c).alias(c + side) for c in lead.columns))
    apart = F.least("lowa", "lowb") != F.greatest("higha", "highb")
    linked = similar.join(of("a"), "ha").join(of("b"), "hb").where(apart)
    linked = linked.select(F.least("repa", "repb").alias("a"), F.greatest("repa", "repb").alias("b"), "jaccard", F.lit("similar").alias("kind"))
    copies = salted_join(rows.select("h", "id"), lead.where("n > 1").select("h", "rep"), "h", "id").where("id <> rep")
    return linked.union(copies.select("rep", "id", F.lit(1.0), F.lit("copy")))


def _two_least(df: DataFrame, key: str) -> DataFrame:
    """Of ``(key, g, m)`` the rows with the two least m of each key, one row a group."""
    best = df.groupBy(key, "g").agg(F.min("m").alias("m"))
    return best.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy("m", "g"))).where("_place <= 2").drop("_place")


def near_rejects(df: DataFrame, order: str, group: str, text_col: str = "text", threshold: float = 0.85) -> DataFrame:
    """``(order, near_duplicate_of)`` of rows for which an earlier row of another group has an equal or similar text; the
    least such row. A class's two least rows of different groups answer for all of its rows, so no pairs are made."""
    rows = _rows(df, order, group, text_col)
    heads = materialize(_two_least(rows.select("h", "g", F.col("id").alias("m")), "h"), "heads")
    similar = similar_texts(rows.groupBy("h").agg(F.first("t").alias("t")), threshold)
    links = similar.select("ha", "hb").union(similar.select("hb", "ha"))
    met = links.join(heads, F.col("hb") == F.col("h")).select(F.col("ha").alias("h"), "g", "m").union(heads.select("h", "g", "m"))
    offers = _two_least(met, "h").groupBy("h").agg(F.collect_list(F.struct("m", "g")).alias("offers")).where(F.size("offers") > 1)
    asked = salted_join(rows.select("h", "id", "g"), offers, "h", "id")
    least = F.array_min(F.transform(F.filter("offers", lambda x: x["g"] != F.col("g")), lambda x: x["m"]))
    return asked.select(F.col("id").alias(order), least.alias("near_duplicate_of")).where(F.col("near_duplicate_of") < F.col(order))


def near_edges(df: DataFrame, order: str, group: str, text_col: str = "text", threshold: float = 0.85) -> DataFrame:
    """Group edges ``(a, b)`` from equal and similar texts: a star per class of equal texts, never all of its pairs."""
    rows = _rows(df, order, group, text_col)
    lead = materialize(rows.groupBy("h").agg(F.min("g").alias("least"), F.max("g").alias("most")), "classes")
    equal = salted_join(rows.select("h", "g").distinct(), lead.where("least <> most"), "h", "g").select(F.col("g").alias("a"), F.col("least").alias("b"))
    similar = similar_texts(rows.groupBy("h").agg(F.first("t").alias("t")), threshold)
    linked = similar.join(lead.select(F.col("h").alias("ha"), F.col("least").alias("a")), "ha").join(lead.select(F.col("h").alias("hb"), F.col("least").alias("b")), "hb")
    return equal.union(linked.select("a", "b")).where("a <> b")


def duplicate_clusters(df: DataFrame, order: str, group: str, text_col: str = "text", threshold: float = 0.85) -> DataFrame:
    """``(group, cluster)``: groups joined by equal or similar texts; the cluster is its least group."""
    roots = connected_components(near_edges(df, order, group, text_col, threshold))
    groups = df.select(F.col(group).alias("g")).distinct()
    return groups.join(roots, F.col("g") == F.col("node"), "left").select(F.col("g").alias(group), F.coalesce("root", "g").alias("cluster"))
