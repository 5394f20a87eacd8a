"""Python gets few texts at once, and words are found once a message."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import text as X
from granary.functions.romanize import Tables, transliterate
from granary.operators import validation as V
from granary.operators.workspace import TEXTS, materialize
from granary.plans import records as P


@F.arrow_udf(T.LongType())
def _at_once(texts: pa.Array) -> pa.Array:
    return pa.array([len(texts)] * len(texts))


def test_materialize_bounds_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    df = spark.range(5000).coalesce(1).select(_at_once("id").alias("n"))
    assert materialize(df, "sizes", TEXTS).agg(F.max("n")).first()[0] <= TEXTS
    assert spark.conf.get(key) == before


def test_texts_of_slices_keep_their_places(spark):
    rows = [(i, None if i % 9 == 0 else ("é मेरो " * (i % 3)) + str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, t string").coalesce(1)
    got = {r.i: (r.c, r.p) for r in df.select("i", X.nfc("t").alias("c"), transliterate(Tables())("t").alias("p")).collect()}
    import unicodedata

    assert all(got[i][0] == (None if t is None else unicodedata.normalize("NFC", t)) for i, t in rows)
    assert all((got[i][1] is None) == (t is None) for i, t in rows) and got[4][1].startswith("é mero") is False and got[4][1].endswith("4")


def test_words_are_found_once(spark):
    """The plans of the markers and of the checks hold the words' expression once."""
    for df in (P.language_markers(spark, "/root/testdata/sf0.001"), V.check(P.records(spark, "/root/testdata/sf0.001"), P.TAXONOMY)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(lower(") - plan.count("regexp_extract_all(lower(translate(") == 1
