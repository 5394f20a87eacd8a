"""Hand-checkable values and invariants of the engine's operators."""

import math

import pytest
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import metrics as M
from granary.operators.components import connected_components
from granary.operators.dedup import duplicate_clusters, exact_duplicates
from granary.operators.logs import ingest
from granary.operators.records import findings
from granary.operators.retrieval import auc
from granary.operators.splits import assign
from granary.operators.sync import plan
from granary.operators.thresholds import best_threshold


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"), [("१०,०००", [10000.0]), ("1.5k", [1.5, 1500.0]), ("5 hajar", [5.0, 5000.0]), ("2 lakh", [2.0, 200000.0]), ("", [])]
)
def test_amounts(spark, text, want):
    assert one(spark, text, X.amounts_in) == want


def test_text_scalars(spark):
    assert one(spark, "छैन", X.normalize) == "छ न"
    assert one(spark, "Hello,  WORLD_1!", X.normalize) == "hello world_1"
    assert [one(spark, t, X.detect_script) for t in ("छ", "abc", "छ a", "12")] == ["deva", "roman", "mixed", "roman"]
    assert [one(spark, t, X.has_negation) for t in ("चल्दैन", "paisa aayena", "all good")] == [True, True, False]
    assert [one(spark, t, X.question_language) for t in ("छ", "mero paisa", "my money")] == ["deva", "roman", "en"]


def test_coverage_at_error(spark):
    df = spark.createDataFrame([(0.9, True, 1), (0.8, True, 2), (0.7, False, 3), (0.6, True, 4)], "conf double, correct boolean, id long")
    assert tuple(M.coverage_at_error(df, 0.25, "id").first()) == (1.0, 0.6)
    assert tuple(M.coverage_at_error(df, 0.0, "id").first()) == (0.5, 0.8)


def test_nll_brier_ece(spark):
    rows = [([0.8, 0.2], "a", True)] * 3 + [([0.8, 0.2], "b", False)]
    df = spark.createDataFrame(rows, "p array<double>, gold string, correct boolean").withColumn("conf", F.lit(0.8))
    assert df.agg(F.avg(M.brier("p", ["a", "b"], "gold"))).first()[0] == pytest.approx((3 * 0.08 + 1.28) / 4)
    assert df.agg(F.avg(M.nll(F.when(F.col("correct"), 0.8).otherwise(0.2)))).first()[0] == pytest.approx((-3 * math.log(0.8) - math.log(0.2)) / 4)
    assert M.ece(df).first()["ece"] == pytest.approx(0.05)


def test_auc_and_threshold(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, True), (0.1, False), (0.8, False)], "s double, y boolean")
    assert auc(df, "s", "y").first()["auc"] == pytest.approx(0.875)
    gate = lambda ok, bad, kept: best_threshold(
        spark.createDataFrame([(x, False) for x in ok] + [(x, True) for x in bad], "s double, r boolean"), "s", "r", kept
    ).first()["threshold"]
    assert gate((0.8, 0.85, 0.9), (0.6, 0.7), 1.0) == pytest.approx(0.75)
    assert gate((0.7, 0.8, 0.9), (0.75, 0.6), 1.0) == pytest.approx(0.65)
    assert gate((0.7, 0.8, 0.9), (0.75, 0.6), 0.6) == pytest.approx(0.775)
    assert gate((0.5, 0.9), (0.7,), 1.0) < 0.5


@pytest.mark.parametrize("parts", [1, 5])
def test_components(spark, parts):
    edges = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, i) for i in range(101, 140)] + [(None, 3), (7, 7), (1, 0)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(parts)).collect()}
    want = {i: i // 10 * 10 for i in range(40)} | {i: 100 for i in range(100, 140)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_duplicates_and_leakage(spark):
    rows = [(1, "g1", "Some text here, quite long enough!"), (2, "g2", "some TEXT here quite long enough"), (3, "g1", "some text here quite long enough"), (4, "g3", "other words altogether"), (5, "g4", None)]
    df = spark.createDataFrame(rows, "id long, g string, text string")
    assert [tuple(r) for r in exact_duplicates(df, "id", "g").collect()] == [(2, 1)]
    clusters = {r["g"]: r["cluster"] for r in duplicate_clusters(df.where("id < 5"), "id", "g").collect()}
    assert clusters == {"g1": "g1", "g2": "g1", "g3": "g3"}
    many = spark.range(4000).select(F.concat(F.lit("c"), F.col("id")).alias("c"))
    shares = {r["split"]: r["n"] / 4000 for r in assign(many, "c", "s").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert abs(shares["train"] - 0.8) < 0.03 and abs(shares["test"] - 0.1) < 0.02


def test_status_sync_ingest(spark):
    df = spark.createDataFrame([(1, 5, False), (2, 50, True), (3, 50, None)], "id long, n int, disputed boolean")
    got = findings(df, [("short", F.col("n") < 8)], F.col("disputed"))
    assert {r["id"]: r["status"] for r in got.collect()} == {1: "rejected", 2: "queued", 3: "accepted"}
    t = spark.createDataFrame([(1, "a", "m"), (2, "b", "m")], "k long, c string, m string")
    assert {r["action"] for r in plan(t, t, "k", "c", "m").collect()} == {"unchanged"}
    e = spark.createDataFrame([(1, "k", "x"), (2, "k", "x"), (3, "k", "y"), (4, None, "x"), (5, None, "x")], "id long, key string, body string")
    assert {r["id"]: r["outcome"] for r in ingest(e, "key", F.col("body"), ["id"]).collect()} == {1: "stored", 2: "replay", 3: "conflict", 4: "stored", 5: "stored"}


def test_near_pairs_star_copies_and_rejects_equal_all_pairs(spark):
    from itertools import combinations

    from granary.operators.dedup import near_pairs, near_rejects

    base = " ".join(f"word{i} stays" for i in range(60))
    texts = [base] * 30 + [base + f" tail{i}" for i in range(6)] + ["quite other words here", None, "", "ab"]
    rows = [(i, f"g{i // 3}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, g string, text string")
    found = near_pairs(df, "id", "g").collect()
    copies = {(r.a, r.b) for r in found if r.kind == "copy"}
    assert copies == {(0, i) for i in range(1, 30)}
    similar = {(r.a, r.b) for r in found if r.kind == "similar"}
    leads = [0, *range(30, 36)]
    # 30, 31, 32 and 33, 34, 35 are of one group each, and each is alone with its text
    assert similar == {(a, b) for a, b in combinations(leads, 2) if a == 0 or rows[a][1] != rows[b][1]}
    alike = lambda a, b: a < 36 and b < 36
    want = {b: a for b in range(36) for a in reversed(range(b)) if alike(a, b) and rows[a][1] != rows[b][1]}
    assert {r.id: r.near_duplicate_of for r in near_rejects(df, "id", "g").collect()} == want
    assert near_pairs(df.limit(0), "id", "g").count() == 0 and near_rejects(df.limit(0), "id", "g").count() == 0


def test_shingles_as_integers_equal_sets():
    from granary.operators.dedup import _Shingles, jaccard_of

    def plain(x, y):
        a, b = ({t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in (x, y))
        return len(a & b) / len(a | b)

    wide = "".join(chr(0x4E00 + i) for i in range(6_500))  # more characters than there is room for
    texts = ["", "a", "abcd", "abcde", "abcdef abcdef", "abcdéf 🙂 abc", "a" * 50, wide, wide[10:], wide[:300] + "abcdef"]
    known = _Shingles()
    for x in texts:
        for y in texts:
            assert jaccard_of(x, y, known) == plain(x, y)


def test_salted_join(spark):
    from granary.operators.joins import salted_join

    many = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 50), (3, 51), (None, 52)], "k int, v int")
    one = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z"), (None, "n")], "k int, w string")
    got = sorted(map(tuple, salted_join(many, one, "k", "v").collect()))
    assert got == sorted([(1, i, "x") for i in range(50)] + [(2, 50, "y")])
