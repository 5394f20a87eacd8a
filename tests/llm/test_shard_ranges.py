"""Ranges grow in number with the rows, hot texts included, and the result stays the same."""

from granary.llm import sharding


def test_more_ranges_same_shards(spark, monkeypatch):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i} " * (i % 9)) for i in range(4000)] + [(None, None), (7, "hot text"), (7, "hot text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = ("doc_id", "size", "text_crc32", "shard", "slot")
    few = sorted(map(str, sharding.shard_by_bytes(docs, shards=5).select(*order).collect()))
    monkeypatch.setattr(sharding, "RANGE_ROWS", 10)
    many = sharding.shard_by_bytes(docs, shards=5)
    assert sorted(map(str, many.select(*order).collect())) == few
    assert sharding.shard_by_bytes(docs.limit(0), shards=5).count() == 0
