"""Bootstrap intervals rest on as many samples as the reference draws, and their ends are its percentiles."""

import pytest

from granary.plans import evaluation as E

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, hits", [("bootstrap_ci", lambda r: r["a"]), ("paired_difference", lambda r: r["a"] - r["b"])])
def test_interval_of_a_thousand_samples(spark, name, hits):
    samples = E._samples(spark, DATA).collect()
    assert sorted(r["sample"] for r in samples) == list(range(1000))
    values = sorted(hits(r) / r["n"] for r in samples)
    got = getattr(E, name)(spark, DATA).first()
    assert tuple(got) == pytest.approx((values[25], values[974]), abs=1e-6)


def test_resampled_sums_are_those_of_rows(spark):
    """The same draws as a row for each sample and group; the plan makes no such rows."""
    from pyspark.sql import functions as F

    from granary.functions.hashing import poisson, resampled, uniform

    g = spark.createDataFrame([(f"g{i:03}", i % 5 + 1, i % 3) for i in range(150)], "grp string, n long, a long")
    got = resampled(g, "grp", ["n", "a"], "boot", 70)
    m = poisson(uniform("boot", F.col("sample"), F.col("grp")))
    rows = g.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(69)))).withColumn("m", m)
    want = rows.groupBy("sample").agg(F.sum(F.col("n") * F.col("m")).alias("n"), F.sum(F.col("a") * F.col("m")).alias("a"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
