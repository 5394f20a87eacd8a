"""Articles, JSON lines, answers and the ingesting stream against hand-computed results."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from granary.operators.answering import respond
from granary.operators.grounding import verbatim
from granary.sources.articles import chunks, load_articles, packed, paragraphs, parse
from granary.sources.jsonlines import file_digests, join_back, read_array, read_lines, write_indexed, write_lines
from granary.streaming.ingest import ingest_stream

ARTICLE = "---\r\nid: a-en\r\ndomain: shop\r\nlang: en\r\ntitle: 'Pay: later'\r\nupdated_at: 2026-01-02\r\n---\r\n\r\nSteps:\r\n\r\n- one\r\n- two\r\n\r\nThe  end.\r\n"


def put(folder, name, text):
    (folder / "shop").mkdir(exist_ok=True)
    (folder / "shop" / name).write_bytes(text.encode())


def test_article(spark, tmp_path):
    put(tmp_path, "a.md", ARTICLE)
    row = load_articles(spark, str(tmp_path)).first()
    assert (row.id, row.title, str(row.updated_at), row.body) == ("a-en", "Pay: later", "2026-01-02", "Steps:\n\n- one\n- two\n\nThe  end.")
    got = chunks(load_articles(spark, str(tmp_path)), limit=20).orderBy("position").collect()
    assert [c.text for c in got] == ["Steps: - one - two", "The end."]
    assert got[1].chunk_id == "a-en#" + hashlib.sha256(b"Pay: later\nThe end.").hexdigest()[:12]
    put(tmp_path, "b.md", ARTICLE)
    with pytest.raises(Exception, match="duplicate document id a-en"):
        load_articles(spark, str(tmp_path)).collect()


@pytest.mark.parametrize(
    ("text", "problem"),
    [(None, "missing front matter"), ("", "missing front matter"), ("---\nid: x\n---\nb", "front matter lacks domain, lang, title, updated_at"),
     (ARTICLE.replace("shop", "farm"), "unknown domain or language"), (ARTICLE.replace("2026-01-02", "soon"), "updated_at is no date"), (ARTICLE, None)],
)
def test_problems(spark, text, problem):
    assert parse(spark.createDataFrame([(text,)], "value string")).first()["problem"] == problem


def test_packing(spark):
    body = "a\n\n  \n\nb" + "c" * 30 + "\n\nd\n\ne:\n\n- f\n\n- g"
    row = spark.createDataFrame([(body,)], "b string").select(paragraphs(F.col("b")).alias("p"), packed(paragraphs(F.col("b")), 10).alias("k")).first()
    assert row.p == ["a", "b" + "c" * 30, "d", "e:\n- f", "- g"]
    assert row.k == ["a", "b" + "c" * 30, "d\n\ne:\n- f", "- g"]


def test_lines(spark, tmp_path):
    rows = spark.createDataFrame([(2, "ब"), (1, None)], "id long, t string")
    path = str(tmp_path / "out")
    assert write_lines(rows, path) == 2
    assert write_lines(rows, path, append=True) == 2
    assert sorted(tuple(r) for r in read_lines(spark, path, rows.schema).collect() if r.t) == [(2, "ब")] * 2
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n\n{"id": \n')
    with pytest.raises(Exception, match="bad.jsonl: not a record"):
        read_lines(spark, str(tmp_path / "bad.jsonl"), "id long").collect()
    (tmp_path / "rows.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    assert read_array(spark, str(tmp_path / "rows.json"), "id long").count() == 2
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert file_digests(spark, str(tmp_path / "f.bin")).first()["sha256"] == hashlib.sha256(b"abc").hexdigest()


def test_indexed_export(spark, tmp_path):
    rows = spark.range(50).select("id", F.concat(F.lit("m"), F.col("id")).alias("body"))
    assert write_indexed(rows, "id", "body", ["id"], str(tmp_path / "x")) == 50
    index = spark.read.json(str(tmp_path / "x" / "index"))
    answers = index.select(F.concat(F.lit("run/"), F.col("line")).alias("id"), F.explode(F.array(F.lit("q1"), F.lit("q2"))).alias("question"), F.col("line").alias("value"))
    back = join_back(answers, index, ["q1", "q2"])
    assert back.where("id = line AND q1 = line AND q2 = line").count() == 50
    lines = [line for f in sorted((tmp_path / "x" / "lines").glob("part-*")) for line in f.read_text().split()]
    assert lines == [f"m{i}" for i in range(50)]


def test_answers(spark):
    questions = spark.createDataFrame([(i, "How?") for i in range(5)], "question_id int, question string")
    hits = spark.createDataFrame([(i, "c", "d", "Pay at the desk.", 0.1 if i == 0 else 0.9) for i in range(4)], "question_id int, chunk_id string, doc_id string, text string, score double")
    cite = "array<struct<chunk_id: string, quote: string>>"
    drafts = [(0, False, "x", [("c", "Pay")]), (1, True, None, []), (2, False, "x", [("other", "Pay"), ("c", ""), ("c", "desks")]), (3, False, "x", [("c", "Pay  at"), ("c", "Pay at"), ("c", "desk.")])]
    drafts = spark.createDataFrame(drafts, f"question_id int, refused boolean, answer string, citations {cite}")
    got = respond(questions, hits, drafts, 0.5).orderBy("question_id").collect()
    assert [r.refusal_reason for r in got] == ["low_similarity", "model_declined", "no_valid_citation", None, "low_similarity"]
    assert [c.quote for c in got[3].citations] == ["Pay at", "desk."] and got[3].answer == "x"
    assert got[0].citations == [] and got[0].answer.startswith("Sorry")


def test_short_quotes(spark):
    quotes = spark.createDataFrame([(0, "a"), (1, "ab c"), (2, "bcd"), (3, " "), (4, None), (5, "x ab cd y"), (6, "zz")], "q int, text string")
    texts = spark.createDataFrame([(10, "x ab  cd y"), (11, "abcd"), (12, ""), (13, None)], "t int, text string")
    got = sorted(map(tuple, verbatim(quotes, "q", texts, "t").collect()))
    assert got == [(0, 10), (0, 11), (1, 10), (2, 11), (5, 10)]


def test_ingest_over_batches(spark, tmp_path):
    shape, src, out = "n int, k string, body string", tmp_path / "in", str(tmp_path / "state")
    outcomes = {}
    for rows in ([(1, "a", "x"), (2, "a", "y"), (3, None, "x")], [(4, "a", "x"), (5, "b", "x"), (6, None, "x")], [(7, "a", "z"), (8, "b", "x")]):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(shape).parquet(str(src))
        outcomes = dict(tuple(r) for r in ingest_stream(stream, "k", F.sha2("body", 256), ["n"], out).select("n", "outcome").collect())
    assert [outcomes[i] for i in range(1, 9)] == ["stored", "conflict", "stored", "replay", "stored", "stored", "conflict", "replay"]
