"""SimHash near-duplicates (operator 4): 64-bit fingerprints of word shingles; BK-trees over shards find all links."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.components import connected_components
from granary.operators.joins import counted_join
from granary.operators.workspace import materialize, release

#: Distinct fingerprints of a shard above which its tree is broadcast and its queries are dealt to all tasks.
HOT_SHARD = 2048
#: Nodes of all broadcast trees together (24 bytes each); with more, a hot shard's queries are dealt to so many copies of
#: its tree at most.
TREE_NODES, MOST_COPIES = 1 << 20, 16
#: Mean fingerprints of a shard above which a scheme with more key bits is used. All schemes find the same links.
FULL_SHARD = 64
#: Rows of the table of hot shards up to which it is broadcast; a larger one is joined by a shuffle.
HOT_BROADCAST = 100_000
#: (query, node) pairs that a tree search holds at once, before and after going down an edge.
FRONT = 1 << 19


def fingerprint(text: bytes, size: int = 3) -> int:
    """Majority of the XXH64 (seed 42) bits of the text's word shingles; zero without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``(id, fp)`` of every row, ``fp`` as a signed long. Null and empty texts get zero. A map without a shuffle."""
    schema = T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", size) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


class Forest:
    """BK-trees of many shards, built and searched in whole batches. Children hang on their parent by Hamming distance."""

    def __init__(self, shard: np.ndarray, code: np.ndarray):
        """``shard``: dense shard numbers; ``code``: uint64, distinct within a shard. Node i is item i."""
        n = len(code)
        self.code = code
        self.parent = np.full(n, -1)
        self.edge = np.zeros(n, np.int64)
        order = np.argsort(shard, kind="stable")
        first = order[np.r_[True, shard[order][1:] != shard[order][:-1]]] if n else order
        self.root = np.empty(int(shard.max()) + 1 if n else 0, np.int64)
        self.root[shard[first]] = first
        at = self.root[shard]
        moving = np.flatnonzero(at != np.arange(n))
        at = at[moving]
        while len(moving):
            d = np.bitwise_count(code[moving] ^ code[at]).astype(np.int64)
            slot = at * 65 + d
            _, lead, group = np.unique(slot, return_index=True, return_inverse=True)
            child = moving[lead]
            self.parent[child], self.edge[child] = at[lead], d[lead]
            at = child[group]
            rest = moving != at
            moving, at = moving[rest], at[rest]
        self.kids = np.argsort(self.parent, kind="stable")
        self.kids = self.kids[np.searchsorted(self.parent[self.kids], 0) :]
        owners = self.parent[self.kids]
        self.start = np.searchsorted(owners, np.arange(n))
        self.stop = np.searchsorted(owners, np.arange(n), "right")

    def search(self, query: np.ndarray, start: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in ``query``, node) within ``radius``; each query starts at its node in ``start``. An edge of length e
        is followed only where the distance to the parent differs from e by the radius at most."""
        stack = [(np.arange(len(query)), start)]
        while stack:
            who, node = stack.pop()
            n = self.stop[node] - self.start[node]
            total = int(n.sum())
            if max(total, len(who)) > FRONT and len(who) > 1:
                half = len(who) // 2
                stack += [(who[half:], node[half:]), (who[:half], node[:half])]
                continue
            d = np.bitwise_count(query[who] ^ self.code[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield who[near], node[near]
            if not total:
                continue
            which = np.repeat(np.arange(len(node)), n)
            kid = self.kids[np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[node], n)]
            follow = np.abs(self.edge[kid] - d[which]) <= radius
            if follow.any():
                stack.append((who[which[follow]], kid[follow]))


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of a and b pairwise; ``root`` points every member at or towards the least one."""

    def tops(x: np.ndarray) -> np.ndarray:
        while True:
            up = root[x]
            if (root[up] == up).all():
                return up
            root[x] = root[up]
            x = up

    while len(a):
        ra, rb = tops(a), tops(b)
        apart = ra != rb
        a, b = ra[apart], rb[apart]
        if len(a):
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))


def shard_edges(shard: np.ndarray, code: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each shard that the asking rows take part in, as pairs of row numbers."""
    forest = Forest(shard, code)
    root = np.arange(len(code))
    close = np.flatnonzero((forest.parent >= 0) & (forest.edge <= radius))
    _unite(root, close, forest.parent[close])
    asking = np.flatnonzero(asks)
    for who, node in forest.search(code[asking], forest.root[shard[asking]], radius):
        _unite(root, asking[who], node)
    while (root[root] != root).any():
        root = root[root]
    linked = np.flatnonzero(root != np.arange(len(code)))
    return linked, root[linked]


def key_schemes(radius: int) -> list[tuple[int, int]]:
    """(blocks, blocks that must agree), from few key bits to many: codes within the radius agree on blocks - radius."""
    return [(radius + extra, extra) for extra in range(1, 5)]


def scheme(total: int, radius: int) -> tuple[int, int]:
    """The scheme with the fewest keys whose shards stay small for so many codes."""
    schemes = key_schemes(radius)
    return next((s for s in schemes if total / 2 ** (64 * s[1] // s[0]) <= FULL_SHARD), schemes[-1])


def key_masks(blocks: int, agree: int) -> list[int]:
    """For each choice of ``agree`` blocks of a code, a mask of their bits."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(bounds, bounds[1:])]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), agree)]


def _keys(fp: str, blocks: int, agree: int) -> list:
    """Shard keys: the number of each mask and the bits under it."""
    signed = [m - (1 << 64) if m >> 63 else m for m in key_masks(blocks, agree)]
    return [
        F.struct(F.lit(i).alias("kind"), F.col(fp).bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)
    ]


def deal(codes: DataFrame, radius: int, code: str = "fp") -> tuple[DataFrame, DataFrame]:
    """``(dealt, hot)``. ``dealt`` is ``codes`` with ``shard``, a row for each shard that a row belongs to: rows within the
    radius of each other meet in one shard at least. ``hot`` are the shards over HOT_SHARD rows, with their ``rows``, as a
    sixteenth of all codes shows them."""
    keys = F.explode(F.array(*_keys(code, *scheme(codes.count(), radius)))).alias("k")
    dealt = codes.select("*", keys).select(*codes.columns, F.xxhash64("k").alias("shard"))
    drawn = dealt.where(F.pmod(F.xxhash64(F.lit("hot"), code), F.lit(16)) == 0).groupBy("shard").agg(F.count("*").alias("n"))
    return dealt, materialize(drawn.where(F.col("n") > HOT_SHARD // 16).select("shard", (F.col("n") * 16).alias("rows")), "hot")


def _sharded_edges(dealt: DataFrame, radius: int) -> DataFrame:
    """Links within shards whose rows, with ``asks``, meet in one task each."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        shard = np.unique(table["shard"].to_numpy(), return_inverse=True)[1]
        fp = table["fp"].to_numpy()
        a, b = shard_edges(shard, fp.view(np.uint64), table["asks"].to_numpy(), radius)
        yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    return dealt.select("fp", "shard", "asks").repartition("shard").mapInArrow(run, "a long, b long")


def _broadcast_edges(hot: DataFrame, radius: int) -> DataFrame:
    """Links within the hot shards: their trees are built once and broadcast, their codes are searched for in all tasks."""
    held = hot.select("shard", "fp").toArrow()
    shards, shard = np.unique(held["shard"].to_numpy(), return_inverse=True)
    trees = hot.sparkSession.sparkContext.broadcast((shards, Forest(shard, held["fp"].to_numpy().view(np.uint64))))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shards, forest = trees.value
        root = np.arange(len(forest.code))
        for batch in batches:
            if not batch.num_rows:
                continue
            start = forest.root[np.searchsorted(shards, batch.column(0).to_numpy())]
            query = batch.column(1).to_numpy().view(np.uint64)
            # a query is itself a node of its tree: the first found at distance zero stands for it
            mine = np.full(len(query), -1)
            for who, node in forest.search(query, start, 0):
                mine[who] = node
            for who, node in forest.search(query, start, radius):
                _unite(root, mine[who], node)
        while (root[root] != root).any():
            root = root[root]
        linked = np.flatnonzero(root != np.arange(len(root)))
        fp = forest.code.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], names=["a", "b"])

    parts = int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = hot.select("shard", "fp").repartition(min(parts, -(-held.num_rows // HOT_SHARD)), F.xxhash64("fp", "shard"))
    return spread.mapInArrow(run, "a long, b long")


def near_edges(codes: DataFrame, radius: int = 3, fp: str = "fp") -> DataFrame:
    """Pairs ``(a, b)`` of codes that connect all codes within ``radius`` of each other: a spanning forest per shard and
    task, never all pairs of a group.

    ``codes`` holds distinct longs. They are dealt to shards by pigeonhole keys; each shard's tree is searched for each of
    its codes, where the shard is or, if it is hot, in all tasks, to which the trees of hot shards are broadcast while they
    have TREE_NODES nodes at most in all. Beyond that a hot shard is copied, MOST_COPIES times at most.
    """
    dealt, hot = deal(codes.select(F.col(fp).alias("fp")), radius)
    asking = dealt.withColumn("asks", F.lit(True))
    if not (n := hot.count()):
        return _sharded_edges(asking, radius)
    few = F.broadcast(hot) if n <= HOT_BROADCAST else hot
    cold = _sharded_edges(asking.join(few.select("shard"), "shard", "left_anti"), radius)
    crowded = materialize(dealt.join(few.select("shard", "rows"), "shard"), "crowded")
    if crowded.count() <= TREE_NODES:
        return cold.union(_broadcast_edges(crowded, radius))
    copies = F.least(F.ceil(F.col("rows") / HOT_SHARD), F.lit(MOST_COPIES)).cast("int")
    copied = crowded.withColumn("copies", copies).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    copied = copied.select("fp", F.xxhash64("shard", "copy").alias("shard"), (F.pmod(F.xxhash64("fp"), "copies") == F.col("copy")).alias("asks"))
    return cold.union(_sharded_edges(copied, radius))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3
) -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row.

    Fingerprints at ``radius`` or fewer differing bits link, and components are transitive; ``component_id`` is the
    least id of the component. Equal fingerprints collapse before any join, so a text with many copies costs what one
    does. Null, empty and blank texts have fingerprint zero and link like others. Null ids stay rows of their own;
    they never become a component id unless all its ids are null. Repeated rows repeat. An empty table gives an empty
    result. Other columns are not read.
    """
    found = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
    codes = materialize(found.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "codes")
    roots = connected_components(near_edges(codes.select("fp"), radius))
    grouped = codes.join(roots, codes["fp"] == roots["node"], "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root")
    )
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    grouped = counted_join(grouped, least, "root", "m", codes.count())
    classes = materialize(grouped.select("fp", "component_id", "n"), "classes")
    release(codes)
    return counted_join(found, classes, "fp", "n", found.count()).select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
