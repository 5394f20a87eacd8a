"""Byte-level BPE vocabulary: file loading, pre-tokens and the merge loop shared by encoding and counting."""

from __future__ import annotations

import heapq
import json

import regex

#: The pre-token pattern of the public byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    """Where the box keeps the vocabulary; callers may pass any other file of the same format."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class ByteBPE:
    """One vocabulary: ``encode_piece`` merges a pre-token's bytes; ``token_bytes[id]`` is what an id stands for."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        vocab = spec["model"]["vocab"]
        self.byte_ids = [vocab[c] for c in symbols]
        self.token_bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.token_bytes |= {i: s.encode() for s, i in self.special.items()}
        self.pieces = regex.compile(PATTERN).findall
        self._at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def split_special(self, text: str) -> list[tuple[str, int | None]]:
        """``text`` cut at special strings: (ordinary text before, id of the special string after or None)."""
        if self._at_special is None or not self._at_special.search(text):
            return [(text, None)]
        out, start = [], 0
        for m in self._at_special.finditer(text):
            out.append((text[start : m.start()], self.special[m[0]]))
            start = m.end()
        return [*out, (text[start:], None)]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. A heap orders candidate merges by (rank, place) over a doubly linked symbol list;
        entries whose symbols have changed since they were pushed are stale and skipped."""
        symbols = [self.byte_ids[b] for b in piece]
        n = len(symbols)
        if n < 2:
            return symbols
        merges = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := merges.get((symbols[i], symbols[i + 1])):
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((made, symbols[k])):
                    heapq.heappush(heap, (found[0], i, made, symbols[k], found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((symbols[h], made))):
                heapq.heappush(heap, (found[0], h, symbols[h], made, found[1]))
        return [s for s in symbols if s >= 0]


_LOADED: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """The vocabulary at ``path``, read once per process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]
