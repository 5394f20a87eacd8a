"""Near duplicates among long texts of few syllables: unrelated ones are no candidates, similar ones are all found."""

import random

from granary.operators import dedup as D


def _texts(spark, many, syllables=60, words=2500):
    draw = random.Random(5)
    parts = ["".join(draw.choice("aeioustnrl") for _ in range(2)) for _ in range(syllables)]
    return [" ".join("".join(draw.choices(parts, k=2)) for _ in range(words)) for _ in range(many)]


def test_unrelated_long_texts_are_no_candidates(spark):
    texts = _texts(spark, 60)
    shingles = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    likeness = [len(a & b) / len(a | b) for k, a in enumerate(shingles) for b in shingles[:k]]
    assert min(likeness) > 0.3  # bands of four rows made candidates of most of these pairs
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    assert D._candidates(df, 0.85).count() < len(likeness) / 20


def test_similar_texts_are_those_of_brute_force(spark):
    draw, rows = random.Random(7), []
    for base in [x[: 5 * n] for x, n in zip(_texts(spark, 12, 900, 1200), (6, 20, 43, 60, 170, 205, 210, 400, 700, 900, 1000, 1200), strict=True)]:
        for edits in (0, 1, 2, 4, 6, 8):
            words = base.split(" ")
            for _ in range(edits * len(words) // 120 + (edits > 0)):
                words[draw.randrange(len(words))] = str(draw.randrange(10**4))
            rows.append(" ".join(words))
    rows = sorted(set(rows))
    sets = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in rows]
    j = lambda a, b: len(a & b) / len(a | b)
    want = {(i, k): j(sets[i], sets[k]) for k in range(len(rows)) for i in range(k) if j(sets[i], sets[k]) >= 0.85}
    df = spark.createDataFrame([(f"{i:03}", t) for i, t in enumerate(rows)], "h string, t string")
    got = {(int(r.ha), int(r.hb)): r.jaccard for r in D.similar_texts(df).collect()}
    assert want and got == want


def test_cells_are_cut(spark, monkeypatch):
    """One large group of near copies goes through many cells and tiles, and no pair is lost."""
    monkeypatch.setattr(D, "TILE", 7)
    monkeypatch.setattr(D, "CELL", 5)
    base = "".join(random.Random(3).choices("abcdefghij ", k=600))
    df = spark.createDataFrame([(f"{i:03}", f"{base}{i:03}") for i in range(60)], "h string, t string")
    assert D.similar_texts(df).count() == 60 * 59 // 2
