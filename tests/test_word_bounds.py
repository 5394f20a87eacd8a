"""Ends of words next to letters beyond ASCII are where SQL sees them."""

import duckdb
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.plans import corpus
from granary.plans.base import SQL


def test_checks_equal_sql_next_to_accents(spark, tmp_path):
    texts = ["ñno es", "el año no", "énot here", "noé never", "no_one note", "été nó", "lano", "पैसाno more", "no", "never-no"]
    docs = [(i, t + " " * 8, "en", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = {tuple(r) for r in con.sql(SQL["record_checks"]).df().itertuples(index=False)}
    assert {tuple(r) for r in corpus.record_checks(spark, str(tmp_path)).collect()} == want
    assert sum("negated" in r[1] for r in want) == 7


def test_amounts_end_before_accents(spark):
    row = spark.createDataFrame([("5kñ",)], "t string").select(X.amounts_in(F.col("t"))).first()
    assert row[0] == [5.0, 5000.0]
