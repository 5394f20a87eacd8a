"""One item id with several texts: each text's windows are found, and the id counts once."""

import random

import duckdb

from granary.llm import decontam
from granary.llm import queries as Q


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(f"word{draw.randint(0, 9999)}" for _ in range(n))


def test_one_id_with_two_texts(spark):
    texts = [prose(k, 30) for k in range(4)]
    benchmark = [(1, texts[0]), (1, texts[1]), (1, texts[2]), (2, texts[3]), (2, texts[3]), (3, "one two"), (3, "three four")]
    rows = [(k, prose(50 + k, 9) + " " + x + " " + prose(60 + k, 9)) for k, x in enumerate(texts)]
    rows += [(10, " ".join(texts[0].split()[3:17]) + " " + texts[1]), (11, "zero one two"), (12, "three four five"), (13, "two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(benchmark, "item_id long, text string").repartition(5)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", items.toPandas())
    want = con.sql(Q.OP8_SQL)
    got = decontam.find_benchmark(docs, items).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
