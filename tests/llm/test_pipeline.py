"""The corpus pipeline: every stage's decision on planted documents, and stages that keep what is clean."""

import random

import pytest

import corpus_pipeline as P


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(draw.randint(2, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    docs = {i: "\n".join(line(20) for _ in range(6)) for i in range(300)}
    toxic = set(range(0, 300, 7))
    for i in toxic:
        docs[i] += "\nyou are a grobbish and snarvile person"
        docs[i] = docs[i].replace(" ", " grobbish ", 3)
    passage, item = line(60), line(30)
    clean = [i for i in range(300) if i not in toxic]
    docs[1000] = docs[clean[0]]
    docs[1001] = docs[clean[1]].replace(docs[clean[1]].split()[9], "changed")
    docs[1002] = line(20) + "\n" + item + "\n" + line(20)
    docs[1003], docs[1004] = line(40) + "\n" + passage, line(40) + "\n" + passage
    docs[1005], docs[1006] = "", None
    d = str(tmp_path_factory.mktemp("planted"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, set(clean), toxic, passage


def test_stages(spark, planted):
    d, clean, toxic, passage = planted
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        after = P.materialize(stage(spark, docs, d), name)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        docs, kept[name] = after, {r["doc_id"]: r["text"] for r in after.collect()}
    assert len(kept["toxicity"].keys() & toxic) <= len(toxic) * 0.1
    assert clean <= kept["toxicity"].keys()
    assert 1000 not in kept["line_dedup"] and 1001 not in kept["line_dedup"]
    assert passage in kept["line_dedup"][1003] and passage not in kept["line_dedup"][1004]
    assert len(kept["near_dedup"].keys() & {1005, 1006}) == 1
    assert 1002 in kept["near_dedup"] and 1002 not in kept["decontaminate"]
    assert clean <= kept["decontaminate"].keys()
    last = P.STAGES[-1][1](spark, docs, d)
    assert {r["doc_id"] for r in last.collect()} == kept["decontaminate"].keys()


def test_run_equals_stages(spark, planted):
    d, clean, *_ = planted
    out = P.run(spark, d).collect()
    assert clean <= {r["doc_id"] for r in out} and all(r["n_tokens"] > 0 for r in out if r["doc_id"] in clean)
