"""Line dedup (operator 1): lines meet by pigeonhole on their rarest words, are bounded by length and by a fingerprint of
parity bits, verified by edit similarity and grouped; of each connected group one occurrence stays.

A SimHash cannot carry an edit similarity of 0.8: a fifth of the words moves a fifth of its bits, and blocks that survive
that tell nothing apart. The fingerprint here differs in no more bits than the words do, so its radius loses no pair.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.simhash import _unite
from granary.operators.components import connected_components
from granary.operators.joins import salted_join
from granary.operators.workspace import materialize, release

#: Least edit similarity of linked lines.
SIMILARITY = 0.8
#: Bounds of a line's words from which its fingerprint has the next number of 64-bit words.
WIDTHS = ((0, 3), (110, 6), (300, 12), (620, 24), (1250, 48), (2500, 96), (5000, 192))
#: Share of the documents whose words show which are rare, at least so many, and the places (as a power of 2) of the table
#: that tells. They order words: what they hold changes the number of candidates, never a result.
SAMPLE_SHARE, SAMPLE_LEAST, COUNT_BITS = 1 / 256, 16_384, 22
#: The same sample for keys of very many lines.
HOT_LEAST = 1024
#: Lines that may hold a word before it stands for candidates only together with a second one.
HOT_WORD = 4096
#: Words of the longer line of a pair from which single words stand for candidates all the same: such lines are few, and
#: pairs of their words would be many.
FEW_LINES = 300
#: Rows of a key, or lines of a candidate group, above which they are dealt to several tasks; how many keys are looked up
#: for that (their rows stay together beyond it).
HOT_SHARD, HOT_KEYS = 4096, 100_000
#: Rows of a key, and lines of a candidate group, from which a first line is compared with all others before any others are
#: compared.
LARGE_KEY, LARGE = 4096, 64
#: Words of a line from which its words are compared as a multiset before they are compared in order.
LONG = 1024
#: Bits of the filter that tells which lines' words are worth sending: its size is fixed, and what it lets through in
#: vain is dropped by an exact join.
FILTER_BITS = 1 << 26
#: Bytes of keys for each word of the corpus, about; a partition of keys has some 8 MB.
KEY_BYTES = 9
#: Bytes of keys that a task packs at once, and rows of them that it makes at once (in 64-bit words of fingerprints).
PACKED, MADE = 1 << 23, 1 << 18
#: Bytes of lines whose words are hashed at once.
RUN = 1 << 18
#: Documents whose lines are made at once.
SLICE = 1000
MIX = np.uint64(0x9E3779B97F4A7C15)

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\r\x0b\x0c"
_PLAIN = bytes(range(256)).lower().translate(bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION)))
_BYTES = np.random.default_rng(1).integers(0, 1 << 64, 256, np.uint64)
_BYTES[[10, 32]] = 0


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    base = 0x5851F42D4C957F2D
    return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)]) for x in (base, pow(base, -1, 1 << 64)))


@cache
def _is_blank(c: str) -> bool:
    """Whether a character beyond ASCII is punctuation, a symbol or white space; marks belong to the letters they follow."""
    return not c.isalnum() and unicodedata.category(c)[0] != "M"


def canonical_lines(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(lines, words of each line, lines of each text): the words of each line, one blank between them, in lower case and
    without punctuation, ASCII or other: what equality and similarity are about."""
    raw = [x if x.isascii() else x.decode("utf-8", "replace").lower().encode("utf-8", "replace") for x in texts]
    of_text = np.array([x.count(b"\n") + 1 for x in raw], np.int64)
    run = b"\n".join(raw) + b"\n"
    if not run.isascii():
        signs = np.frombuffer(run, np.uint8)
        blanks = sorted(filter(_is_blank, set(signs[signs > 127].tobytes().decode("utf-8"))))
        if len(blanks) > 32:
            run = run.decode("utf-8").translate(dict.fromkeys(map(ord, blanks), " ")).encode("utf-8")
        else:
            for c in blanks:
                run = run.replace(c.encode("utf-8"), b" ")
    signs = np.frombuffer(run.translate(_PLAIN), np.uint8)
    gap = (signs == 32) | (signs == 10)
    # blanks before a blank or an end go, then those at the start of a line
    signs = signs[~((signs == 32) & np.r_[gap[1:], False])]
    leading = (signs == 32) & np.r_[True, signs[:-1] == 10]
    if leading.any():
        signs = signs[~leading]
    ends = np.flatnonzero(signs == 10)
    sizes = np.diff(np.searchsorted(np.flatnonzero(signs == 32), ends), prepend=0) + (np.diff(ends, prepend=-1) > 1)
    return signs.tobytes().split(b"\n")[:-1], sizes, of_text


def canonical(text: str | bytes) -> list[bytes]:
    """The canonical lines of a text."""
    return canonical_lines([text if isinstance(text, bytes) else text.encode("utf-8", "replace")])[0]


def normalised(text: str) -> list[list[bytes]]:
    """The words of each line of a text."""
    return [x.split(b" ") if x else [] for x in canonical(text)]


def edit_similarity(a: list[bytes], b: list[bytes]) -> float:
    """1 - Levenshtein distance of two word sequences / length of the longer one, by Myers' bit vectors."""
    longest = max(len(a), len(b))
    if not longest:
        return 1.0
    start, ends = 0, (len(a), len(b))
    while start < min(ends) and a[start] == b[start]:
        start += 1
    m, n = ends
    while m > start and n > start and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    a, b = a[start:m], b[start:n]
    if not a or not b:
        return 1 - max(len(a), len(b)) / longest
    places: dict[bytes, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for w in b:
        eq = places.get(w, 0)
        across = (((eq & up) + up) ^ up) | eq
        more, fewer = down | (full & ~(across | up)), up & across
        distance += bool(more & top) - bool(fewer & top)
        eq |= down
        more, fewer = (more << 1 | 1) & full, (fewer << 1) & full
        up, down = fewer | (full & ~(eq | more)), more & eq
    return 1 - distance / longest


def _codes(digests: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """48 bits of each line's digest above its number of words, 65,535 at most."""
    return np.frombuffer(b"".join(digests), "<u8")[::2] << np.uint64(16) | np.minimum(sizes, 0xFFFF).astype(np.uint64)


def word_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words of each line) of canonical lines that have words. Equal words have equal hashes; what
    collides makes more candidates."""
    text = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    gaps = np.flatnonzero((text == 32) | (text == 10))
    starts = np.r_[0, gaps[:-1] + 1]
    up, down = _powers(max(1 << 19, 1 << len(text).bit_length()))
    hashes = np.add.reduceat(_BYTES[text] * up[: len(text)], starts) * down[starts]
    hashes = (hashes ^ hashes >> np.uint64(31)) * MIX
    return hashes ^ hashes >> np.uint64(29), np.diff(np.flatnonzero(text[gaps] == 10), prepend=-1)


def _allowed(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """The edits that leave lines similar enough to one no longer than they are."""
    return ((1 - similarity) * sizes + 1e-6).astype(np.int64)


def tokens(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, tokens) of lines, fewer than 2^19, sorted within each; ``words`` are numbers below 2^45. The k-th occurrence of
    a word in its line is a token of its own, so lines are sets of tokens, however often words repeat."""
    line = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    ranked = np.sort(line << np.uint64(45) | words)
    at = np.arange(len(ranked), dtype=np.uint64)
    again = at - np.maximum.accumulate(np.where(np.r_[True, ranked[1:] != ranked[:-1]], at, np.uint64(0)))
    words = ranked & np.uint64((1 << 45) - 1)
    token = (words + again * MIX) * MIX
    return words, token ^ token >> np.uint64(29)


def prefixes(order: np.ndarray, key: np.ndarray, sizes: np.ndarray, hot: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the rarest tokens of each line, as many as it takes that similar lines share one, given what
    ``tokens`` makes of words whose highest 8 of 45 bits are their rarity.

    Tokens have one order everywhere: by rarity, hash, occurrence. Lines of which the longer has n words and that are d edits apart share
    n - d tokens; each misses d at most, so the first common one is among the first d + 1 of each, the second among the
    first d + 2. Where the first is in very many lines (rarity of ``hot`` or more), so is the second, and both together
    are the key. Pairs of lines whose longer one has FEW_LINES words meet by single words, kept apart from those of
    shorter lines."""
    # the first tokens of each line, one more than it may miss and one more
    need = _allowed(sizes, similarity) + 1
    few = np.minimum(need + 1, sizes)
    line = np.repeat(np.arange(len(sizes)), few)
    rank = np.arange(len(line)) - np.repeat(np.cumsum(few) - few, few)
    at = rank + np.repeat(np.cumsum(sizes) - sizes, few)
    order, key, need = order[at], key[at], need[line]
    common = (order >> np.uint64(37)).astype(np.int64) >= hot
    first = rank < need
    alone = first & ~common
    single = first & common & (sizes >= similarity * FEW_LINES - 1e-6)[line]
    lines, keys = np.r_[line[alone], line[single]], np.r_[key[alone], (key[single] ^ MIX) * MIX]
    if (first & common).any():
        paired = np.zeros(len(sizes), bool)
        paired[line[first & common]] = True
        paired &= sizes < FEW_LINES
        both = common & paired[line]
        line, key = line[both], key[both]
        n = np.bincount(line, minlength=len(sizes))[line]
        after = n - 1 - (np.arange(len(line)) - np.searchsorted(line, line))
        one = np.repeat(np.arange(len(line)), after)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(after) - after, after)
        lines, keys = np.r_[lines, line[one]], np.r_[keys, (key[one] * np.uint64(3) + key[two]) * MIX]
    return lines, keys


def width(sizes: np.ndarray) -> np.ndarray:
    """Which of WIDTHS lines have."""
    return np.searchsorted([n for n, _ in WIDTHS], sizes, "right") - 1


def parities(token: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """64 * ``words`` bits a line, each the parity of how many of its tokens fall there. Lines differ in no more bits than
    their words as multisets do; words that a line repeats do not cancel out, since each time is a token. Half as many bits are the exclusive or of both halves."""
    bits = 64 * words
    line = np.repeat(np.arange(len(sizes)), sizes)
    low = token.astype(np.uint32)
    counts = np.bincount(line * bits + (low - low // np.uint32(bits) * np.uint32(bits)), minlength=len(sizes) * bits)
    return np.packbits((counts & 1).astype(np.uint8).reshape(-1, bits), axis=1, bitorder="little").view("<u8").astype(np.uint64)


def _texts(batches: Iterator) -> Iterator[bytes]:
    """The texts of Arrow batches of one column, as they are encoded."""
    for batch in batches:
        yield from batch.column(0).cast("large_binary").to_pylist()


def _pieces(texts: Iterator[bytes], most: int) -> Iterator[list[bytes]]:
    """Texts in lists of about ``most`` bytes."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def runs_of_lines(texts: Iterator[bytes], similarity: float) -> Iterator[tuple[list[int], list[bytes]]]:
    """(codes, lines) of the distinct lines of a run of texts that can be similar to others without being equal, in pieces
    that ``prefixes`` can take."""
    seen, codes, lines, size = set(), [], [], 0
    # the shortest line to which one edit may leave another similar has one word less than that
    least = int(np.ceil(1 / (1 - similarity) - 1e-6)) - 2 if similarity < 1 else 1 << 62
    for piece in _pieces(texts, RUN):
        every, sizes, _ = canonical_lines(piece)
        long = np.flatnonzero(sizes > least)
        every = [every[k] for k in long.tolist()]
        for line, code in zip(every, _codes([xxhash.xxh3_128_digest(x) for x in every], sizes[long]).tolist()):
            if code not in seen:
                seen.add(code)
                codes.append(code)
                lines.append(line)
                size += len(line)
                if size > RUN:
                    yield codes, lines
                    codes, lines, size = [], [], 0
    if lines:
        yield codes, lines


def _rarity(sample: DataFrame, share: float, similarity: float) -> tuple[np.ndarray, int, float]:
    """How common the words that fall into each of 2^COUNT_BITS places are, the level from which a word is hot, and the
    number of all words as the sample shows it."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = np.zeros(1 << COUNT_BITS, np.int32)
        for _, lines in runs_of_lines(_texts(batches), similarity):
            at, n = np.unique(word_hashes(lines)[0] >> np.uint64(64 - COUNT_BITS), return_counts=True)
            counts[at.astype(np.int64)] += n.astype(np.int32)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met].astype(np.int64))], names=["place", "n"])

    table = sample.select("_text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    level = lambda n: np.minimum(12 * np.log2(1 + n), 255).astype(np.uint8)
    out = np.zeros(1 << COUNT_BITS, np.uint8)
    out[table["place"].to_numpy()] = level(table["n"].to_numpy())
    words = int(table["n"].to_numpy().sum())
    return out, int(level(np.float64(max(HOT_WORD * share, 4 * words / (1 << COUNT_BITS), 1)))) + 1, words / share


def _trim() -> None:
    """Give memory that is free back to the system: the worker lives on beside the executor."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def _keyed(texts: Iterator[bytes], rarity: tuple, similarity: float) -> Iterator[tuple]:
    """(keys, codes, sizes, bits, width) of runs of lines, a row a key, for each width of fingerprint."""
    for codes, lines in runs_of_lines(texts, similarity):
        hashes, sizes = word_hashes(lines)
        words = rarity[0][hashes >> np.uint64(64 - COUNT_BITS)].astype(np.uint64) << np.uint64(37) | hashes & np.uint64((1 << 37) - 1)
        words, token = tokens(words, sizes)
        line, key = prefixes(words, token, sizes, rarity[1], similarity)
        codes, kinds = np.array(codes, np.uint64), width(sizes)
        for w in np.unique(kinds):
            chosen = np.flatnonzero(kinds == w)
            bits = parities(token[np.repeat(kinds == w, sizes)], sizes[chosen], WIDTHS[w][1])
            of = np.flatnonzero(kinds[line] == w)
            at = np.searchsorted(chosen, line[of])
            step = MADE // WIDTHS[w][1]
            for k in range(0, len(of), step):
                some = at[k : k + step]
                yield key[of[k : k + step]], codes[chosen[some]], sizes[chosen[some]], bits[some], w


def close(n: np.ndarray, m: np.ndarray, apart: np.ndarray, similarity: float) -> np.ndarray:
    """Whether lines of n and m words whose fingerprints are ``apart`` bits apart can be similar."""
    longer, shorter = np.maximum(n, m), np.minimum(n, m)
    fits = (apart <= 2 * _allowed(longer, similarity) - (longer - shorter)) & (longer - shorter <= _allowed(longer, similarity))
    return np.where(longer >= 0xFFFF, True, fits)


def link(group: np.ndarray, n: np.ndarray, bits: np.ndarray, home: np.ndarray, far: np.ndarray, similarity: float, large: int, confirm: Callable) -> None:
    """Pass pairs of rows that may be similar to ``confirm(i, j)``, which links those that are and says which they are.
    Rows are sorted by group, then n; ``bits`` has a column a row. Rows that are not ``far`` are known to be connected; rows
    that are not at ``home`` are copies of rows that are so elsewhere. A pair is looked at where one of its rows is at home
    and the other is far. In a group of ``large`` rows a first line is compared with all others; those that are linked to
    it are not far from each other, so many copies of one text cost a comparison each."""
    n = np.minimum(n, 0xFFFF).astype(np.int64)
    far = far.copy()
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(group)]
    last = np.where(n == 0xFFFF, 1 << 30, (n / similarity + 1e-6).astype(np.int64))

    def against(i: int, rows: np.ndarray) -> np.ndarray:
        """Those of ``rows`` that are linked to row i."""
        near = rows[close(n[rows], n[i], np.bitwise_count(bits[:, rows] ^ bits[:, i, None]).sum(0, dtype=np.int64), similarity)]
        return near[confirm(np.full(len(near), i), near)] if len(near) else near

    for a, b in zip(starts[ends - starts > large], ends[ends - starts > large]):
        if (home[a:b] & far[a:b]).all():
            first = (a + b) // 2
            far[against(first, np.r_[a:first, first + 1 : b])] = False
            far[first] = False
        low = np.searchsorted(n[a:b], np.ceil(n[a:b] * similarity - 1e-6)) + a
        high = np.searchsorted(n[a:b], last[a:b], "right") + a
        for i in np.flatnonzero(far[a:b]) + a:
            # what is shorter and far has met this row already
            before, after = slice(low[i - a], i), slice(i + 1, high[i - a])
            met = home[after] | far[after] if home[i] else home[after]
            against(i, np.r_[before.start + np.flatnonzero(home[before] & ~far[before]), after.start + np.flatnonzero(met)])
    # how many of the next rows are of the same group and not too long; rows of groups that end early come first, so what
    # is left at each distance is one slice
    reach = np.minimum(np.searchsorted(group << 31 | n, group << 31 | last, "right") - np.arange(len(n)) - 1, np.repeat(np.where(ends - starts > large, 0, 1 << 30), ends - starts))
    most = np.repeat(np.maximum.reduceat(reach, starts), ends - starts)
    order = np.argsort(most, kind="stable")
    order = order[most[order] > 0]
    n, home, far, bits, reach, most = n[order].astype(np.int32), home[order], far[order], bits[:, order], reach[order].astype(np.int32), most[order]
    # bits apart must be this many at most, less what the shorter line lacks
    room = np.where(n == 0xFFFF, 1 << 29, 2 * _allowed(n, similarity) - n).astype(np.int32)
    plain = home.all() and far.all()
    start = k = 0
    while True:
        k += 1
        start += int(np.searchsorted(most[start:], k))
        if start + k >= len(n):
            break
        for a in range(start, len(n) - k, 1 << 16):
            b = min(a + (1 << 16), len(n) - k)
            apart = np.bitwise_count(bits[0, a:b] ^ bits[0, a + k : b + k]).astype(np.int32)
            for row in bits[1:]:
                apart += np.bitwise_count(row[a:b] ^ row[a + k : b + k])
            fits = (apart <= room[a + k : b + k] + n[a:b]) & (reach[a:b] >= k)
            if not plain:
                fits &= (home[a:b] & far[a + k : b + k]) | (far[a:b] & home[a + k : b + k])
            near = np.flatnonzero(fits) + a
            if len(near):
                confirm(order[near], order[near + k])


def _order(group: np.ndarray, n: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.lexsort((code, n, group))


def _key_links(blobs: dict[int, bytes], similarity: float) -> np.ndarray:
    """A forest of candidate links among the rows of a partition, as pairs of codes. A row is a key, in whose last bits
    stands whether it is at home and far, a code, and the fingerprint."""
    edges, wider = [], None
    for w in range(len(WIDTHS) - 1, -1, -1):
        words = WIDTHS[w][1]
        rows = np.frombuffer(blobs.get(w, b""), np.uint64).reshape(-1, 2 + words)
        if wider is not None:
            # lines just above the bound meet those below it with half their bits
            short = wider[(wider[:, 1] & np.uint64(0xFFFF)) <= np.uint64(int(WIDTHS[w + 1][0] / similarity) + 1)]
            half = short[:, 2 : 2 + words] ^ short[:, 2 + words :]
            rows = np.concatenate([rows, np.concatenate([short[:, :2], half], 1)])
        wider = np.frombuffer(blobs.get(w, b""), np.uint64).reshape(-1, 2 + words)
        if len(rows) < 2:
            continue
        # most keys are those of one line: only the others' rows are sorted and copied
        key = rows[:, 0] >> np.uint64(2)
        by_key = np.argsort(key)
        sorted_key = key[by_key]
        twin = sorted_key[1:] == sorted_key[:-1]
        by_key = by_key[shared := np.r_[twin, False] | np.r_[False, twin]]
        if not len(by_key):
            continue
        key, code = sorted_key[shared], rows[by_key, 1]
        group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        # one number to sort by: group, n, some of the code; a line that stands twice all the same is only met twice
        rest = 48 - int(group[-1]).bit_length()
        order = np.argsort(group.astype(np.uint64) << np.uint64(16 + rest) | (code & np.uint64(0xFFFF)) << np.uint64(rest) | code >> np.uint64(64 - rest))
        code = code[order]
        fresh = np.r_[True, (group[1:] != group[:-1]) | (code[1:] != code[:-1])]
        rows, group, code = rows[by_key[order[fresh]]], group[fresh], code[fresh]
        n = (code & np.uint64(0xFFFF)).astype(np.int64)
        root = np.unique(code, return_inverse=True)
        parent = np.arange(len(root[0]))

        def confirm(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            _unite(parent, root[1][i], root[1][j])  # noqa: B023
            return np.ones(len(i), bool)

        link(group, n, np.ascontiguousarray(rows[:, 2:].T), (rows[:, 0] & np.uint64(1)).astype(bool), (rows[:, 0] & np.uint64(2)).astype(bool), similarity, LARGE_KEY, confirm)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        linked = np.flatnonzero(parent != np.arange(len(parent)))
        edges.append(np.stack([root[0][linked], root[0][parent[linked]]], 1))
    return np.unique(np.concatenate(edges or [np.empty((0, 2), np.uint64)]), axis=0)


def _hot_keys(drawn: DataFrame, share: float, rarity, similarity: float) -> dict[int, tuple[int, int, int, bytes]]:
    """The keys of very many lines: into how many parts to deal their rows, and a line (its code, words, bits) that most
    of them are likely to be close to."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for keys, *_ in _keyed(_texts(batches), rarity.value, similarity):
            met, n = np.unique(keys & ~np.uint64(3), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(met.view(np.int64)), pa.array(n)], names=["key", "n"])

    counted = drawn.select("_text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    listed = counted.where(F.col("n") > max(8, HOT_SHARD * share)).orderBy(F.desc("n"), "key").limit(HOT_KEYS).toArrow()
    if not listed.num_rows:
        return {}
    hot = drawn.sparkSession.sparkContext.broadcast(np.sort(listed["key"].to_numpy().view(np.uint64)))

    def line(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for keys, codes, sizes, bits, w in _keyed(_texts(batches), rarity.value, similarity):
            keys &= ~np.uint64(3)
            at = np.flatnonzero(np.isin(keys, hot.value))
            # one line of each key and run will do
            at = at[np.unique(keys[at], return_index=True)[1]]
            held = pa.array([x.tobytes() for x in bits[at]], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at].view(np.int64)), pa.array(codes[at].view(np.int64)), pa.array(sizes[at].astype(np.int64)), held], names=["key", "code", "n", "bits"]
            )

    rows = drawn.select("_text").mapInArrow(line, "key long, code long, n long, bits binary")
    lines = rows.groupBy("key").agg(F.max_by(F.struct("code", "n", "bits"), F.xxhash64("code")).alias("line")).select("key", "line.*").toArrow()
    number = dict(zip(listed["key"].to_pylist(), listed["n"].to_pylist()))
    parts = lambda n: int(np.ceil(n / share / HOT_SHARD))
    return {x["key"] & (1 << 64) - 1: (parts(number[x["key"]]), x["code"] & (1 << 64) - 1, x["n"], x["bits"]) for x in lines.to_pylist()}


def _split_hot(keys: np.ndarray, codes: np.ndarray, sizes: np.ndarray, bits: np.ndarray, hot: dict, similarity: float) -> tuple[np.ndarray, ...]:
    """Rows with the rows of hot keys dealt to parts: those close to the key's line go to one part each, where they need
    not be compared with each other; the others go to all parts, where they meet the rows that are at home there. Also
    links with the lines of the keys."""
    listed = np.fromiter(hot, np.uint64, len(hot))
    at = np.flatnonzero(np.isin(keys, listed)) if hot else listed
    if not len(at):
        return keys | np.uint64(3), codes, bits, np.empty((0, 2), np.uint64)
    rest = np.setdiff1d(np.arange(len(keys)), at)
    out_keys, rows, edges = [keys[rest] | np.uint64(3)], [rest], []
    for key in np.unique(keys[at]):
        parts, code, n, held = hot[int(key)]
        of = at[keys[at] == key]
        pivot = np.frombuffer(held, np.uint64)
        mine = bits[of]
        while len(pivot) > mine.shape[1]:
            pivot = pivot[: len(pivot) // 2] ^ pivot[len(pivot) // 2 :]
        while len(pivot) < mine.shape[1]:
            mine = mine[:, : mine.shape[1] // 2] ^ mine[:, mine.shape[1] // 2 :]
        near = close(np.minimum(sizes[of], 0xFFFF), np.int64(min(n, 0xFFFF)), np.bitwise_count(mine ^ pivot).sum(1, dtype=np.int64), similarity)
        edges.append(np.stack([codes[of[near]], np.full(near.sum(), code, np.uint64)], 1))
        part = lambda k: (np.uint64(key) + (k + np.uint64(1)) * MIX) * MIX  # noqa: B023, E731
        own = (codes[of] >> np.uint64(16)) % np.uint64(parts)
        out_keys.append(part(own[near]) & ~np.uint64(3) | np.uint64(1))
        rows.append(of[near])
        every = np.tile(np.arange(parts, dtype=np.uint64), int((~near).sum()))
        out_keys.append(part(every) & ~np.uint64(3) | np.uint64(2) | (every == np.repeat(own[~near], parts)).astype(np.uint64))
        rows.append(np.repeat(of[~near], parts))
    rows = np.concatenate(rows)
    return np.concatenate(out_keys), codes[rows], bits[rows], np.concatenate(edges)


def candidates(docs: DataFrame, similarity: float) -> DataFrame:
    """``(node, root)``: the codes of lines that may be similar to others, in connected groups. Any two lines whose edit
    similarity is high enough without being equal are in one group. Keys travel in one packed row for each partition and
    batch."""
    spark = docs.sparkSession
    total = max(docs.count(), 1)
    drawn = lambda table, share: table.where(F.pmod(F.col("_hash"), F.lit(1 << 20)) <= F.lit(int(share * (1 << 20))))
    share = min(1.0, max(SAMPLE_LEAST / total, SAMPLE_SHARE))
    sample = materialize(drawn(docs, share).select("_hash", "_text"), "sample")
    rarity = spark.sparkContext.broadcast(_rarity(sample, share, similarity))
    share = min(1.0, max(HOT_LEAST / total, SAMPLE_SHARE))
    hot = spark.sparkContext.broadcast(_hot_keys(drawn(sample, share), share, rarity, similarity))
    release(sample)
    parts = max(spark.sparkContext.defaultParallelism, int(rarity.value[2] * KEY_BYTES) >> 23)

    def send(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def packed(held: dict) -> pa.RecordBatch:
            at, kind, blob = [], [], []
            for w in list(held):
                rows = np.concatenate(held.pop(w))
                to = ((rows[:, 0] >> np.uint64(2)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.uint64)
                order = np.argsort(to, kind="stable")
                rows, to = rows[order], to[order]
                cut = np.searchsorted(to, np.arange(parts))
                cut = np.r_[cut, len(to)]
                for p in np.flatnonzero(np.diff(cut)):
                    at.append(int(p))
                    kind.append(w)
                    blob.append(rows[cut[p] : cut[p + 1]].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["part", "kind", "blob"])

        held, size = {}, 0
        for keys, codes, sizes, bits, w in _keyed(_texts(batches), rarity.value, similarity):
            keys, codes, bits, edges = _split_hot(keys & ~np.uint64(3), codes, sizes, bits, hot.value, similarity)
            made = np.concatenate([keys[:, None], codes[:, None], bits], 1)
            held.setdefault(int(w), []).append(made)
            if len(edges):
                held.setdefault(-1, []).append(edges)
            size += made.nbytes + edges.nbytes
            if size > PACKED:
                yield packed(held)
                held, size = {}, 0
        if held:
            yield packed(held)
        _trim()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, list[bytes]] = {}
        for b in batches:
            for kind, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                held.setdefault(kind, []).append(blob)
        found = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in held.pop(-1, [])]
        found.append(_key_links({w: b"".join(held.pop(w)) for w in list(held)}, similarity))
        del held
        edges = np.concatenate(found).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], names=["a", "b"])
        _trim()

    dealt = docs.select("_text").mapInArrow(send, "part int, kind int, blob binary").repartitionById(parts, F.col("part"))
    return materialize(connected_components(dealt.mapInArrow(run, "a long, b long")), "candidates")


def _filter_places(codes: np.ndarray) -> np.ndarray:
    """Two places of the filter for each code."""
    mixed = (codes.view(np.uint64) * MIX) ^ codes.view(np.uint64) >> np.uint64(17)
    return np.stack([mixed % np.uint64(FILTER_BITS), (mixed >> np.uint64(38)) % np.uint64(FILTER_BITS)]).astype(np.int64)


def _filter(codes: DataFrame) -> np.ndarray:
    """A Bloom filter of the wanted codes: FILTER_BITS / 8 bytes on the driver, however many there are."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            places = np.unique(_filter_places(batch.column(0).to_numpy()).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(places // 32), pa.array(np.left_shift(1, places % 32))], names=["word", "bits"])

    words = codes.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    table = words.toArrow()
    out[table["word"].to_numpy()] = table["bits"].to_numpy().astype(np.uint32)
    return out


def _lines(docs: DataFrame, id_field: T.StructField, groups: DataFrame) -> DataFrame:
    """``(_id, _hash, line_no, line, code, words)`` of each line with words; ``line`` is a 128-bit hash of its words. The
    words come along where the line is in one of the groups, once a task."""
    schema = T.StructType(
        [
            id_field,
            T.StructField("_hash", T.LongType()),
            T.StructField("line_no", T.IntegerType()),
            T.StructField("line", T.BinaryType()),
            T.StructField("code", T.LongType()),
            T.StructField("words", T.BinaryType()),
        ]
    )
    bits = docs.sparkSession.sparkContext.broadcast(_filter(groups.select("node")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, sent = bits.value, set()
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            start = 0
            for piece in _pieces(iter(batch.column(2).cast("large_binary").to_pylist()), RUN):
                text, sizes, of_text = canonical_lines(piece)
                full = np.flatnonzero(sizes)
                row = np.repeat(np.arange(len(piece)), of_text)
                number = np.arange(len(row)) - np.repeat(np.cumsum(of_text) - of_text, of_text)
                rows = pa.array(row[full] + start)
                start += len(piece)
                text = [text[k] for k in full.tolist()]
                line = [xxhash.xxh3_128_digest(x) for x in text]
                codes = _codes(line, sizes[full])
                at = _filter_places(codes)
                words = [None] * len(text)
                for k in np.flatnonzero(((known[at >> 5] >> (at & 31).astype(np.uint32)) & 1).all(0)).tolist():
                    if (code := int(codes[k])) not in sent:
                        sent.add(code)
                        words[k] = text[k]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(number[full].astype(np.int32)), pa.array(line, pa.binary()), pa.array(codes.view(np.int64)), pa.array(words, pa.binary())],
                    names=schema.names,
                )
        _trim()

    return docs.mapInArrow(run, schema)


def _dealt(lines: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """``(shard, line, code, words, home, far, pivot, whole)``: the lines of each group together. A group over HOT_SHARD lines is
    dealt to parts: those similar to its first line (``pivot``) go to one part each, the others to all."""
    cold = lines.select(F.col("root").alias("shard"), "line", "code", "words", F.lit(True).alias("home"), F.lit(True).alias("far"), F.lit(None).cast("binary").alias("pivot"), F.lit(True).alias("whole"))
    big = groups.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > HOT_SHARD)
    big = materialize(big.select("root", F.ceil(F.col("n") / HOT_SHARD).cast("int").alias("parts")), "hot")
    if not (n := big.count()):
        return cold
    small = F.broadcast(big) if n <= HOT_KEYS else big
    first = lines.where(F.col("code") == F.col("root")).join(small, "root").groupBy("root").agg(F.max("parts").alias("parts"), F.min(F.struct("line", "words")).alias("first"))
    first = materialize(first.select("root", "parts", F.col("first.line").alias("pivot"), F.col("first.words").alias("first")), "pivots")
    schema = cold.schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = [[] for _ in schema.names]
            for x in batch.to_pylist():
                near = x["line"] == x["pivot"] or edit_similarity(x["words"].split(b" "), x["first"].split(b" ")) >= similarity
                own = (x["code"] >> 16) % x["parts"]
                for part in [own] if near else range(x["parts"]):
                    shard = xxhash.xxh64_intdigest(f"{x['root']} {part}") - (1 << 63)
                    for held, value in zip(out, (shard, x["line"], x["code"], x["words"], part == own, not near, x["pivot"] if near else None, False)):
                        held.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.binary(), pa.bool_()))], names=schema.names)

    of_big = salted_join(lines, first, "root", "line")
    apart = cold.join(small.select(F.col("root").alias("shard")), "shard", "left_anti")
    return apart.union(of_big.mapInArrow(run, schema))


def _verified(lines: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """``(node, root)`` of lines whose words are similar enough, in connected groups. Candidates are compared within their
    groups; a pair whose lines are connected already is not compared again, so a large group costs little more than one
    comparison for each line."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        code = table["code"].to_numpy()
        order = _order(table["shard"].to_numpy(), code.view(np.uint64) & np.uint64(0xFFFF), code)
        table = table.take(pa.array(order))
        text, shard, line = table["words"].to_pylist(), table["shard"].to_numpy(), table["line"].to_pylist()
        fresh = np.r_[True, (shard[1:] != shard[:-1]) | np.array([a != b for a, b in zip(line, line[1:])], bool)]
        if not fresh.all():
            table = table.filter(pa.array(fresh))
            text, shard, line = table["words"].to_pylist(), table["shard"].to_numpy(), table["line"].to_pylist()
        group = np.cumsum(np.r_[False, shard[1:] != shard[:-1]])
        sizes = np.array([x.count(b" ") + 1 for x in text])
        bits, k = [], 0
        sums = np.cumsum([len(x) for x in text])
        while k < len(text):
            to = max(k + 1, int(np.searchsorted(sums, sums[k] + RUN)))
            bits.append(parities(tokens(word_hashes(text[k:to])[0] >> np.uint64(19), sizes[k:to])[1], sizes[k:to], 32).T)
            k = to
        parent = list(range(len(text)))
        split: dict[int, list[bytes]] = {}

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def words(x: int) -> list[bytes]:
            if x not in split:
                if len(split) > 10_000:
                    split.clear()
                split[x] = text[x].split(b" ")
            return split[x]

        def few(x: int, y: int) -> bool:
            """Whether long lines lack too many of each other's words to be similar."""
            if max(sizes[x], sizes[y]) < LONG:
                return False
            a, b = (np.sort(word_hashes([text[v]])[0]) for v in (x, y))
            common = np.minimum(*(np.searchsorted(v, u, "right") - np.searchsorted(v, u) for u in [np.unique(a)] for v in (a, b))).sum()
            return max(sizes[x], sizes[y]) - common > _allowed(max(sizes[x], sizes[y]), similarity)

        def confirm(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            alike = np.zeros(len(i), bool)
            for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
                a, b = top(x), top(y)
                if a == b:
                    alike[k] = True
                elif not few(x, y) and edit_similarity(words(x), words(y)) >= similarity:
                    alike[k] = True
                    parent[max(a, b)] = min(a, b)
            return alike

        link(group, np.minimum(sizes, 0xFFFF), np.ascontiguousarray(np.concatenate(bits, 1)), *(table[c].to_numpy(zero_copy_only=False) for c in ("home", "far")), similarity, LARGE, confirm)
        root = np.array([top(x) for x in range(len(text))])
        at = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
        whole, pivot = table["whole"].to_pylist(), table["pivot"].to_pylist()
        out = [(line[x], line[root[x]], whole[x]) for x in at.tolist()] + [(x, p, False) for x, p in zip(line, pivot) if p is not None]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.bool_()))], names=["node", "root", "whole"])

    dealt = _dealt(lines, groups, similarity)
    found = materialize(dealt.repartition("shard").mapInArrow(run, "node binary, root binary, whole boolean"), "similar")
    roots = found.where("whole").select("node", "root")
    if found.where("NOT whole").limit(1).count():
        roots = roots.union(connected_components(found.where("NOT whole"), "node", "root"))
    return roots


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(row, text, n_lines, n_removed, share_left)`` of every row; ``row`` is the input row as a struct.

    Lines are what newlines separate; words are runs of anything but white space and punctuation, in any case. Lines with
    words link if they have equal words or the edit similarity of their words is ``similarity`` or more (for lines of
    under four words and 0.8 that is equality); of each connected group the first occurrence stays, by id (nulls first),
    text hash and line number. Lines without words always stay. ``text`` is what stays, joined by newlines: empty if
    nothing does, null for a null text; ``share_left`` is the share of its words that stays (1 where no line goes). Rows
    that repeat an id and text count once and all get the same result. An empty table gives an empty result; input
    columns of any name ride along in ``row``. A very long text is one row of one task at a time, a very long line is
    compared like any other; hot lines and groups are dealt to many tasks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"))
    plain = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    groups = candidates(plain, similarity)
    lines = materialize(_lines(plain, plain.schema["_id"], groups), "lines")
    texts = lines.where(F.col("words").isNotNull()).select("line", "code", "words")
    texts = materialize(texts.join(groups, F.col("code") == F.col("node")).select("line", "code", "words", "root"), "words")
    roots = materialize(_verified(texts, groups, similarity), "roots")
    release(texts, groups)
    again = lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select(F.col("line").alias("node"))
    involved = roots.union(again.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    marked = materialize(
        lines.select("_id", "_hash", "line_no", "line").join(involved, F.col("line") == F.col("node")).select("_id", "_hash", "line_no", "root"), "marked"
    )
    release(lines, roots)
    firsts = marked.groupBy("root").agg(F.min(F.struct("_id", "_hash", "line_no")).alias("first"))
    both = marked.select("_id", "_hash", "line_no", F.lit(False).alias("stays")).union(firsts.select("first._id", "first._hash", "first.line_no", F.lit(True)))
    gone = (
        both.groupBy(F.col("_id").alias("_doc"), F.col("_hash").alias("_doc_hash"))
        .agg(F.collect_set(F.when(~F.col("stays"), F.col("line_no"))).alias("met"), F.collect_set(F.when(F.col("stays"), F.col("line_no"))).alias("kept"))
        .select("_doc", "_doc_hash", F.array_except("met", "kept").alias("gone"))
        .where(F.size("gone") > 0)
    )
    joined = rows.join(gone, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_doc_hash")), "left")
    whole = F.col(f"row.`{text_col}`")
    left = F.array_join(F.filter(F.split(whole, "\n"), lambda x, i: ~F.map_contains_key("_gone", i)), "\n")
    n_words = lambda c: F.size(F.array_remove(F.split(c, "[\\x20\\x09-\\x0D]+"), ""))
    return (
        joined.select("row", F.map_from_arrays("gone", F.transform("gone", lambda x: F.lit(True))).alias("_gone"))
        .select("row", "_gone", F.when(F.col("_gone").isNull(), whole).otherwise(left).alias("text"))
        .select(
            "row",
            "text",
            F.coalesce(1 + F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))), F.lit(1)).cast("long").alias("n_lines"),
            F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
            F.when(F.col("_gone").isNull(), F.lit(1.0)).otherwise(n_words(F.col("text")) / n_words(whole)).alias("share_left"),
        )
    )
