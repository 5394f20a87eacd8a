"""Every stage meets nulls, empty and very long texts, ties, repeated rows, clashing column names and empty tables."""

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    item = "the benchmark passage that leaks into some of the documents word by word"
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(12)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), item


@pytest.fixture(scope="module")
def rows(odd):
    return odd.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars", "row", "_id AS _key", "fp AS _kept", "score AS _bad", "shard", "n_words")


def test_stages(spark, tables, rows):
    folder, item = tables
    whole = rows.unionByName(rows.limit(1).selectExpr("CAST(99 AS BIGINT) AS doc_id", f"'before {item} after' AS text", *rows.columns[2:]))
    docs, ids = whole, lambda df: sorted((r[0] is None, r[0] or 0) for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        assert made.count() <= before, name
        if name == "line_dedup":
            assert set(ids(made)) >= {(False, 13), (False, 14), (False, 18), (False, 15), (False, 16)}
            again = {(r["doc_id"], r["text"]) for r in made.where("doc_id = 12").select("doc_id", "text").collect()}
            assert len(again) <= 1
        if name == "near_dedup":
            assert made.where("coalesce(trim(text), '') = ''").count() == 1
        if name == "decontaminate":
            assert made.where("doc_id = 99").count() == 0 and before - made.count() == 1
        docs = spark.createDataFrame(made.collect(), made.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == docs.count() and last.where("n_tokens IS NULL").count() == 0
