"""Lines that say one passage again and again are told apart by how often each word comes, however often that is."""

import random

from pyspark.sql import functions as F

from granary.llm import line_dedup


def test_repeated_passages_are_no_candidates(spark):
    draw = random.Random(5)
    passages = [[f"w{draw.randrange(60)}" for _ in range(28)] for _ in range(150)]
    rows = [(i, " ".join(p * 10)) for i, p in enumerate(passages)]
    near = " ".join((passages[0] * 10)[:-1] + ["other"])
    docs = spark.createDataFrame(rows + [(len(rows), near)], "doc_id long, text string")
    plain = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.col("text").alias("_text"))
    assert line_dedup.candidates(plain, 0.8).count() == 2
    got = line_dedup.dedup_lines(docs).where("n_removed > 0").select("row.doc_id").collect()
    assert [r["doc_id"] for r in got] == [len(rows)]
