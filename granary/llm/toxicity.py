"""Toxicity (operator 2): gradient-boosted trees over dense features of a text, with isotonic calibration.

The lexicon (words and word beginnings that go with the label), the trees and the calibration are learned from labelled
rows, crosswise: what a row is judged by while learning comes from other rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.workspace import materialize

#: Labelled rows to learn from at most, those with the least hash of their id; lexicon entries at most.
FIT_ROWS = 16_000
#: Labelled rows that a unit of the lexicon must stand in.
LEAST = 3
#: Parts of the labelled rows that learn from each other.
FOLDS = 3
#: Standard deviations by which a lexicon entry must exceed chance: entries are many, so chance offers some far-out ones.
SURPLUS = 4.4
#: Score from which a text counts as toxic.
TOXIC = 0.7
#: Words that address the reader, and characters that stand for letters in disguised words.
SECOND_PERSON = set(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch ihr usted ustedes ti tus".split()
)
DISGUISE = str.maketrans("@4310$5!7", "aaeiossit")
_EDGES = ".,;:!?\"'()[]{}<>«»“”‘’…-–—*_~`"
_MIXED = re.compile(r"[^\W\d_][@$!*\d]+[^\W\d_]|^[@$\d][^\W\d_]{2}|[^\W\d_]\*+$").search
_MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
FEATURES = 14


def _clean(token: str) -> str:
    return token.strip(_EDGES).lower()


def _units(word: str) -> list[str]:
    """What of a word the lexicon may hold: the word itself and its beginnings."""
    return [word] + [word[:k] + "*" for k in (4, 5, 6) if len(word) > k]


class _Tokens(dict):
    """Token -> None, or (weight, disguised, second person, all capitals) where one of them is set. A bounded memory."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def _weight(self, word: str) -> float:
        return max((self.lexicon.get(u, 0.0) for u in _units(word)), default=0.0) if word else 0.0

    def __missing__(self, token: str):
        word = _clean(token)
        weight, mixed = self._weight(word), bool(_MIXED(token.strip(".,;:?\"'()")))
        if not weight and mixed:
            weight = self._weight(word.translate(DISGUISE).replace("*", ""))
        found = (weight, mixed, word in SECOND_PERSON, len(word) > 1 and token.isupper())
        found = found if any(found) else None
        if len(self) > 400_000:
            self.clear()
        if len(token) <= 64:
            self[token] = found
        return found


def features(text: str, tokens: _Tokens) -> list[float]:
    """FEATURES numbers: lexicon hits and densities, nearness of second-person words, capitals, punctuation, disguises."""
    words = text.split()
    n = max(len(words), 1)
    marked = [(i, m) for i, m in enumerate(map(tokens.__getitem__, words)) if m]
    hits = [(i, m[0]) for i, m in marked if m[0]]
    second = [i for i, m in marked if m[2]]
    near, k = 0.0, 0
    for i, _ in hits:
        while k + 1 < len(second) and abs(second[k + 1] - i) <= abs(second[k] - i):
            k += 1
        if second:
            near = max(near, 1 / (1 + abs(second[k] - i)))
    raw = text.encode("utf-8", "replace")
    size = max(len(raw), 1)
    weights = [w for _, w in hits]
    return [
        np.log1p(len(hits)),
        100 * len(hits) / n,
        max(weights, default=0.0),
        np.log1p(sum(weights)),
        near,
        100 * len(second) / n,
        (size - len(raw.translate(None, _CAPITALS))) / size,
        100 * sum(m[3] for _, m in marked) / n,
        100 * (text.count("!") + text.count("?")) / n,
        (size - len(raw.translate(None, _MARKS))) / size,
        100 * sum(m[1] for _, m in marked) / n,
        np.log1p(sum(bool(m[1] and m[0]) for _, m in marked)),
        np.log1p(len(words)),
        float(len({round(w, 3) for w in weights})),
    ]


class Boosted:
    """Gradient-boosted regression trees under logistic loss; splits on quantile bins, trees of a fixed depth."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.bias, self.trees = float(np.log(p / (1 - p))), []
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(c) else np.empty(0) for c in x.T]
        if len(y) < 20 or y.min() == y.max():
            return self
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], axis=1)
        margin = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-margin))
            tree, node = self._grow(binned, y - prob, prob * (1 - prob))
            self.trees.append(tree)
            margin += tree[2][node]
        return self

    def _grow(self, binned: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> tuple:
        """(feature, cut value, leaf value) by heap-numbered node, and the leaf of each row."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(gradient), np.int64)
        for k in range(size):
            at = np.flatnonzero(node == k)
            g, h = gradient[at].sum(), curvature[at].sum()
            value[k] = self.rate * g / (h + self.ridge)
            if 2 * k + 2 >= size or len(at) < 10:
                continue
            best = (1e-6, -1, 0)
            for f, cuts in enumerate(self.cuts):
                if not len(cuts):
                    continue
                b = binned[at, f]
                gl = np.bincount(b, gradient[at], len(cuts) + 1).cumsum()[:-1]
                hl = np.bincount(b, curvature[at], len(cuts) + 1).cumsum()[:-1]
                gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
                gain[(hl < 0.5) | (h - hl < 0.5)] = 0
                if gain[j := int(gain.argmax())] > best[0]:
                    best = (float(gain[j]), f, j)
            if best[1] >= 0:
                feature[k], cut[k] = best[1], self.cuts[best[1]][best[2]]
                node[at] = 2 * k + 1 + (binned[at, best[1]] > best[2])
        return (feature, cut, value), node

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + 1 + (x[rows, f] > cut[node]), node)
            out += value[node]
        return out


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points (score, rate) of the non-decreasing fit; rates are smoothed away from 0 and 1."""
    blocks: list[list[float]] = []  # score sum, label sum, rows
    for i in np.argsort(score, kind="stable"):
        blocks.append([score[i], label[i], 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    points = np.array([(s / n, (y + 0.01) / (n + 0.02)) for s, y, n in blocks]).reshape(-1, 2)
    return points[:, 0], np.maximum.accumulate(points[:, 1]) if len(points) else points[:, 1]


class Model:
    """A lexicon, trees, and calibration points; ``score`` maps texts to probabilities."""

    def __init__(self, lexicon: dict[str, float], trees: Boosted, points: tuple[np.ndarray, np.ndarray]):
        self.lexicon, self.trees, self.points = lexicon, trees, points

    def score(self, texts: list[str], tokens: _Tokens) -> np.ndarray:
        if not texts:
            return np.empty(0)
        margin = self.trees.margin(np.array([features(t, tokens) for t in texts], np.float64))
        if not len(self.points[0]):
            return np.zeros(len(texts))
        return np.clip(np.interp(margin, *self.points), 0.0, 1.0)


def held_out(id_col: Column) -> Column:
    """Whether labels of a row may never be learned from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _weights(units: list[dict], pos: float, neg: float, without: int | None = None) -> dict[str, float]:
    """Log odds of the units that go with the label beyond chance, leaving out the counts of one fold."""
    out = {}
    for u in units:
        p, q = (sum(n for k, n in enumerate(u[side]) if k != without) for side in ("p", "q"))
        expected = (p + q) * pos / (pos + neg)
        odds = np.log((p + 0.5) / (pos + 1)) - np.log((q + 0.5) / (neg + 1))
        if p >= LEAST and (p - expected) / np.sqrt(expected + 0.25) >= SURPLUS and odds >= 1.5:
            out[u["unit"]] = min(float(odds), 6.0)
    return out


def _lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """A lexicon without each fold of ``rows`` (_fold, _y, _text), then one of all. Units are counted on the executors;
    those that go with the label beyond chance reach the driver: as many as so many rows have at most."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            unit, row = [], []
            for i, value in enumerate(batch.column(2)):
                found = {u for w in map(_clean, set(value.as_py().split())) if w for u in _units(w)}
                unit += found
                row += [i] * len(found)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(unit, pa.string()), batch.column(0).take(at), batch.column(1).take(at)], names=["unit", "_fold", "_y"]
            )

    totals = {(r["_fold"], r["_y"]): r["n"] for r in rows.groupBy("_fold", "_y").agg(F.count("*").alias("n")).collect()}
    pos = [totals.get((k, 1), 0) for k in range(FOLDS)]
    neg = [totals.get((k, 0), 0) for k in range(FOLDS)]
    if not sum(pos) or not sum(neg):
        return [{}] * (FOLDS + 1)
    units = rows.select("_fold", "_y", "_text").mapInArrow(run, "unit string, _fold int, _y int")
    sides = {
        side: F.array(*(F.count_if((F.col("_fold") == k) & (F.col("_y") == y)) for k in range(FOLDS)))
        for side, y in (("p", 1), ("q", 0))
    }
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    counts = units.groupBy("unit").agg(sides["p"].alias("p"), sides["q"].alias("q"))
    expected = (total("p") + total("q")) * F.lit(sum(pos) / (sum(pos) + sum(neg)))
    surplus = (total("p") - expected) / F.sqrt(expected + 0.25)
    top = counts.withColumn("surplus", surplus).where((F.col("surplus") >= SURPLUS) & (total("p") >= LEAST))
    found = [r.asDict() for r in top.collect()]
    return [_weights(found, sum(pos) - p, sum(neg) - q, k) for k, (p, q) in enumerate(zip(pos, neg))] + [
        _weights(found, sum(pos), sum(neg))
    ]


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS
) -> Model:
    """A model of ``label_col`` from at most ``rows`` labelled rows that are not held out.

    The rows fall into FOLDS by a hash of the id. A row's features come from a lexicon of the other folds, and the
    calibration from margins of trees that were grown on the other folds. Without usable rows every score is 0.
    """
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    usable = usable.groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_y"))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    learned = materialize(
        texts.join(F.broadcast(chosen), "_id").select(
            "_id", F.pmod(F.xxhash64(F.lit("fold"), "_id"), F.lit(FOLDS)).cast("int").alias("_fold"), "_y", "_text"
        ),
        "labelled",
    )
    lexicons = _lexicons(learned)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tokens = [_Tokens(x) for x in lexicons[:FOLDS]]
        for batch in batches:
            x = [features(t.as_py(), tokens[k]) for k, t in zip(batch.column(0).to_pylist(), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64())), batch.column(3)], names=["_fold", "_y", "x", "_h"])

    # ids may repeat in the documents: the bound holds for rows too, of which only the features are brought together
    drawn = learned.select("_fold", "_y", "_text", F.xxhash64("_id", "_text").alias("_h"))
    table = drawn.mapInArrow(run, "_fold int, _y int, x array<double>, _h long").orderBy("_h").limit(rows).drop("_h").toArrow()
    y, folds = (table[c].to_numpy().astype(np.float64) for c in ("_y", "_fold"))
    x = np.array(table["x"].to_pylist(), np.float64).reshape(-1, FEATURES)
    if len(y) < 2:
        return Model(lexicons[-1], Boosted().fit(x, np.zeros(len(y))), (np.empty(0), np.empty(0)))
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        out = folds == k
        margin[out] = Boosted().fit(x[~out], y[~out]).margin(x[out])
    return Model(lexicons[-1], Boosted().fit(x, y), isotonic(margin, y))


def scorer(model: Model):
    """A column function: text -> score."""

    @F.pandas_udf(T.DoubleType())
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = _Tokens(model.lexicon)
        for texts in batches:
            yield pd.Series(model.score([t or "" for t in texts], tokens), dtype="float64")

    return toxicity


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row; ``predicted`` is 1 from a score of TOXIC.

    Only the text enters a score. Null texts count as empty and get the score of an empty text; null ids are not held
    out and carry no label; a label given twice counts once, the higher one. Repeated rows repeat, an empty table gives
    an empty result, and other columns are not read. Scoring is a map over rows.
    """
    score = scorer(fit(docs, labels, id_col, text_col, label_col))
    scored = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score(F.coalesce(F.col(text_col), F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))
