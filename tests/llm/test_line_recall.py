"""Line dedup links all lines whose edit similarity is high enough: brute force over all pairs, no candidate rule."""

import random

import pytest

from granary.llm import line_dedup


@pytest.mark.parametrize("shard, word, large", [(4, 1, 64), (4096, 4, 2), (4096, 4096, 64)])
def test_every_similar_line_is_linked(spark, monkeypatch, shard, word, large):
    monkeypatch.setattr(line_dedup, "HOT_SHARD", shard)
    monkeypatch.setattr(line_dedup, "HOT_WORD", word)
    monkeypatch.setattr(line_dedup, "LARGE", large)
    monkeypatch.setattr(line_dedup, "LARGE_KEY", large)
    monkeypatch.setattr(line_dedup, "LONG", 100)
    monkeypatch.setattr(line_dedup, "FEW_LINES", 110)
    draw = random.Random(11)
    word = lambda: f"w{min(int(draw.paretovariate(0.4)), 4000)}"
    lines = []
    for n in [5, 6, 7, 9, 10, 12, 15, 19, 20, 24, 30, 49, 50, 80, 102, 103, 110, 127, 128, 129, 160, 250] * 3:
        base = [word() for _ in range(n)]
        lines.append(base)
        for edits in (1, n // 5, n // 5, n // 4, n // 4 + 1):
            w = list(base)
            for _ in range(edits):
                k = draw.randrange(len(w))
                how = draw.choice("sdi")
                w[k : k + 1] = [] if how == "d" else [word()] if how == "s" else [w[k], word()]
            lines.append(w)
    lines += [["x"] * 10, ["x"] * 11, ["x"] * 5 + ["y"] * 5, ["y", "x"] * 5]
    draw.shuffle(lines)
    lines = [[x.encode() for x in w] for w in lines]
    group = list(range(len(lines)))
    for a, u in enumerate(lines):
        for b in range(a + 1, len(lines)):
            if group[a] != group[b] and line_dedup.edit_similarity(u, lines[b]) >= 0.8:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    docs = spark.createDataFrame([(i, b" ".join(w).decode()) for i, w in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"] for r in line_dedup.dedup_lines(docs).where("n_removed > 0").select("row.doc_id").collect()}
    want = {i for i, g in enumerate(group) if g != i}
    assert len(want) > 100 and got == want


def test_a_thousand_near_copies_and_a_hot_line(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_SHARD", 64)
    monkeypatch.setattr(line_dedup, "LARGE", 16)
    monkeypatch.setattr(line_dedup, "LARGE_KEY", 16)
    base = [f"b{k}" for k in range(40)]
    rows = []
    for i in range(1000):
        w = list(base)
        w[i % 40], w[(i * 7 + 3) % 40] = f"x{i}", f"y{i}"
        rows.append((i, " ".join(w) + "\nthis very line is in all of the documents"))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("row.doc_id", "n_removed")
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == {i: 2 * (i > 0) for i in range(1000)}


def test_recall_on_real_lines(spark):
    """As many lines go as brute force over all pairs of the given documents says; fingerprints only skip pairs that cannot be
    similar."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    every = [x for (t,) in docs.select("text").collect() for x in line_dedup.canonical(t or "") if x]
    lines = sorted(set(every))
    words, sizes = [x.split(b" ") for x in lines], np.array([x.count(b" ") + 1 for x in lines])
    root = list(range(len(lines)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for i in range(len(lines)):
        for j in np.flatnonzero((np.minimum(sizes[i], sizes) >= 0.8 * np.maximum(sizes[i], sizes) - 1e-6) & (np.arange(len(lines)) > i)).tolist():
            common = len(set(words[i]) & set(words[j]))
            if common >= 1 and line_dedup.edit_similarity(words[i], words[j]) >= 0.8:
                pairs += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    gone = len(every) - len({top(i) for i in range(len(lines))})
    got = line_dedup.dedup_lines(docs).selectExpr("sum(n_removed)").first()[0]
    print(f"{pairs} similar pairs, {gone} lines should go, {got} go")
    assert pairs and got == gone
