"""Very many spans in one text cost what they are, and stand where they should; empty tables and nulls give no spans."""

import time

from granary.llm import pii


def test_many_spans(spark):
    texts = {n: " ".join(f"a{i}@b{i % 7}.org or +1 202 555 {i % 10000:04d}" for i in range(n)) for n in (3, 64, 65, 5000, 16_000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    start = time.time()
    got = {r["doc_id"]: r["found"] for r in pii.find_personal_data(docs).select("doc_id", "found").collect()}
    assert time.time() - start < 30
    for n, text in texts.items():
        mails = [s for s in got[n] if s["kind"] == "email"]
        assert len(mails) == n
        at = 0
        for i, s in enumerate(mails):
            at = text.index(f"a{i}@b{i % 7}.org", at)
            assert (s["start"], s["end"]) == (at, at + len(f"a{i}@b{i % 7}.org"))


def test_nothing(spark, odd):
    assert pii.find_personal_data(odd.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, None), (None, ""), (None, "x@y.zz"), (None, "x@y.zz")], "doc_id long, text string")
    rows = pii.find_personal_data(docs).collect()
    assert sorted(r["n_email"] for r in rows) == [0, 0, 1, 1] and sum(r["max_score"] is None for r in rows) == 2
    assert pii.find_personal_data(odd).count() == odd.count()
