"""Token counts (operator 7): a deterministic transducer whose transitions carry the change in emitted tokens; the state
maps of a text's chunks compose through a prefix scan."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.bytebpe import ByteBPE, default_path, load

#: States and token pairs a worker keeps compiled, and pre-tokens whose path through the states it remembers. Each memory
#: starts afresh when full, which changes no result.
STATES, PAIRS, PATHS = 600_000, 400_000, 300_000
#: Code points of a chunk.
CHUNK = 1 << 16


class CountTransducer(dict):
    """Pre-token -> number of tokens, by a byte transducer that is compiled as far as the input needs.

    A state stands for a prefix of a pre-token and knows the last token of that prefix's encoding. In byte-level BPE
    each prefix has exactly one vocabulary suffix that keeps its own merge result next to the encoding of what
    precedes it, so the next state follows from earlier ones alone; the transition into it is annotated with the
    difference in tokens, negative where a byte completes a merge.
    """

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe = bpe
        self.ids = {b: i for i, b in bpe.token_bytes.items() if i not in bpe.special.values()}
        self.longest = max(map(len, self.ids))
        self._fresh()
        self.parts = {made: (rank, left, right) for (left, right), (rank, made) in bpe.merges.items()}
        self.alone: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}

    def _fresh(self) -> None:
        self.moves: dict[int, int] = {}  # state * 256 + byte -> next state
        self.emits: list[int] = [0]  # tokens that the transition into a state adds
        self.tokens: list[int] = [0]  # tokens of the prefix
        self.last: list[int] = [-1]  # its last token

    def _adjoin(self, a: int, b: int) -> bool:
        """Whether tokens a and b, next to each other, stay as they are.

        Their merges are undone from the latest to the earliest. The two pieces that then touch would have merged with
        each other if their own merge comes before the one just undone; of equal merges the leftmost comes first.
        """
        if a < 0:
            if b not in self.alone:
                self.alone[b] = self.bpe.encode_piece(self.bpe.token_bytes[b]) == [b]
            return self.alone[b]
        key = a << 20 | b
        if (known := self.pairs.get(key)) is not None:
            return known
        merges, parts = self.bpe.merges, self.parts
        bound, stay = 1 << 40, True
        while True:
            crossing = merges.get((a, b))
            if crossing and crossing[0] < bound:
                stay = False
                break
            left, right = parts.get(a), parts.get(b)
            if left and (not right or left[0] > right[0]):
                bound, a = left[0], left[2]
            elif right:
                bound, b = right[0] + 1, right[1]
            else:
                break
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        self.pairs[key] = stay
        return stay

    def _compile(self, piece: bytes, end: int, path: list[int]) -> int:
        for size in range(min(self.longest, end), 0, -1):
            token = self.ids.get(piece[end - size : end])
            if token is not None and self._adjoin(self.last[path[end - size]], token):
                state = len(self.tokens)
                count = self.tokens[path[end - size]] + 1
                self.tokens.append(count)
                self.last.append(token)
                self.emits.append(count - self.tokens[path[end - 1]])
                self.moves[path[end - 1] << 8 | piece[end - 1]] = state
                return state
        raise ValueError("the vocabulary lacks a byte")

    def run(self, piece: bytes) -> int:
        if len(self.tokens) > STATES:
            self._fresh()
        state = total = 0
        path, moves, emits = [0], self.moves, self.emits
        for end, byte in enumerate(piece, 1):
            found = moves.get(state << 8 | byte)
            state = self._compile(piece, end, path) if found is None else found
            path.append(state)
            total += emits[state]
        return total

    def __missing__(self, piece: str) -> int:
        if len(self) > PATHS:
            self.clear()
        count = self.run(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 64:
            self[piece] = count
        return count


class ChunkMap(NamedTuple):
    """What a chunk does to any state it is entered in: text up to its first certain pre-token boundary, tokens between
    that and its last one, and the text after it. ``inner`` is None where there is no such boundary."""

    head: str
    inner: int | None
    tail: str


class Counter:
    """Counts the tokens of texts; chunk maps form a monoid under ``join``."""

    _first = regex.compile(r"\S(?=\s)").search
    _last = regex.compile(r"(?r)\S(?=\s)").search

    def __init__(self, path: str):
        self.bpe = load(path)
        self.transducer = CountTransducer(self.bpe)

    def plain(self, text: str) -> int:
        total, known = 0, self.transducer.__getitem__
        for part, special in self.bpe.split_special(text):
            total += sum(map(known, self.bpe.pieces(part))) + (special is not None)
        return total

    def chunk(self, text: str) -> ChunkMap:
        """A pre-token always starts where white space follows something else, whatever came before."""
        if not (first := self._first(text)):
            return ChunkMap(text, None, "")
        start, end = first.end(), self._last(text).end()
        return ChunkMap(text[:start], self.plain(text[start:end]), text[end:])

    def join(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.inner is None and b.inner is None:
            return self.chunk(a.head + b.head)
        if a.inner is None:
            whole = self.chunk(a.head + b.head)
            return b._replace(head=whole.head, inner=(whole.inner or 0) + self._rest(whole) + b.inner) if whole.inner is not None else b._replace(head=whole.head)
        if b.inner is None:
            whole = self.chunk(a.tail + b.head)
            return a._replace(tail=whole.head) if whole.inner is None else ChunkMap(a.head, a.inner + self.plain(whole.head) + whole.inner, whole.tail)
        return ChunkMap(a.head, a.inner + self.plain(a.tail + b.head) + b.inner, b.tail)

    def _rest(self, whole: ChunkMap) -> int:
        return self.plain(whole.tail)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """All prefixes of the composition, by doubling strides (each round's joins are independent of one another)."""
        step = 1
        while step < len(maps):
            maps = [m if i < step else self.join(maps[i - step], m) for i, m in enumerate(maps)]
            step *= 2
        return maps

    def count(self, text: str, size: int = CHUNK) -> int:
        if len(text) <= size:
            return self.plain(text)
        whole = self.reduce([self.chunk(text[i : i + size]) for i in range(0, len(text), size)])
        return self.plain(whole.head) + (whole.inner or 0) + self.plain(whole.tail)

    def reduce(self, maps: list[ChunkMap]) -> ChunkMap:
        """The last prefix of the scan alone: the up-sweep, which needs one join per chunk."""
        while len(maps) > 1:
            maps = [self.join(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]


_COUNTERS: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 1024
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every row; ``over_limit`` is n_tokens > limit.

    One output row per input row, repeated rows repeat; null and empty texts have no bytes and no tokens. Other input
    columns are not read. A map over rows without a shuffle.
    """
    path = path or default_path()
    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = _counter(path)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n_bytes.append(len(text.encode("utf-8")))
                n_tokens.append(counter.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=schema.names
            )

    counted = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
