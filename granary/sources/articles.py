"""Knowledge-base articles: Markdown files with front matter, their paragraphs and their chunks with stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.text import collapse, nfc

#: Required front-matter keys, domains and languages.
FIELDS = ("id", "domain", "lang", "title", "updated_at")
DOMAINS, LANGS = ("shop", "wallet", "bank"), ("en", "ne")
FRONT = r"(?s)\A---\n(.*?)\n---\n(.*)\z"
#: Characters of a chunk.
LIMIT = 400


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def parse(df: DataFrame, text_col: str = "value") -> DataFrame:
    """Add the front matter's fields, ``body`` and ``problem`` (null for a sound article). Values are plain or quoted
    scalars of one line. A null text has no front matter."""
    text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    front, body = F.regexp_extract(text, FRONT, 1), _strip(F.regexp_extract(text, FRONT, 2))
    value = {f: F.nullif(F.regexp_replace(_strip(F.regexp_extract(front, rf"(?m)^{f}:[ \t]*(.*)$", 1)), "^([\"'])(.*)\\1$", "$2"), F.lit("")) for f in FIELDS}
    day = F.try_to_timestamp(value["updated_at"], F.lit("yyyy-MM-dd")).cast("date")
    missing = F.array_compact(F.array(*(F.when(value[f].isNull(), f) for f in FIELDS)))
    problem = (
        F.when(~text.rlike(FRONT), "missing front matter")
        .when(F.size(missing) > 0, F.concat(F.lit("front matter lacks "), F.array_join(missing, ", ")))
        .when(~value["domain"].isin(*DOMAINS) | ~value["lang"].isin(*LANGS), "unknown domain or language")
        .when(day.isNull(), "updated_at is no date")
    )
    return df.select("*", *(value[f].alias(f) for f in FIELDS[:-1]), day.alias("updated_at"), body.alias("body"), problem.alias("problem"))


def load_articles(spark: SparkSession, path: str) -> DataFrame:
    """The articles of ``path``/*/*.md; an unsound file or an id that two files share is an error naming it."""
    files = spark.read.text(f"{path.rstrip('/')}/*/*.md", wholetext=True).select("value", F.col("_metadata.file_path").alias("source"))
    parsed = parse(files).withColumn("_same", F.count("*").over(Window.partitionBy("id")))
    wrong = F.when(F.col("problem").isNotNull(), F.concat_ws(": ", "source", "problem")).when(F.col("_same") > 1, F.concat(F.lit("duplicate document id "), "id"))
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.col("id"))
    return parsed.select(checked.alias("id"), *FIELDS[1:], "body")


def _fold(items: Column, joins, joiner: str) -> Column:
    """Items in order, one appended to the last result where ``joins(last, item)`` holds."""

    def step(done: Column, item: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        merged = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, F.lit(joiner), item)))
        return F.when((F.size(done) > 0) & joins(last, item), merged).otherwise(F.concat(done, F.array(item)))

    return F.aggregate(items, F.array().cast("array<string>"), step)


def paragraphs(body: Column) -> Column:
    """Paragraphs of an article; a list stays with the lead-in that ends in a colon."""
    parts = F.filter(F.transform(F.split(body, r"\n\s*\n"), _strip), lambda p: p != "")
    return _fold(parts, lambda last, p: p.startswith("- ") & last.endswith(":"), "\n")


def packed(parts: Column, limit: int = LIMIT) -> Column:
    """Paragraphs joined by blank lines while the result stays within ``limit`` characters; longer ones stand alone."""
    return _fold(parts, lambda last, p: F.length(last) + F.length(p) + 2 <= limit, "\n\n")


def chunks(articles: DataFrame, limit: int = LIMIT, compose: bool = True) -> DataFrame:
    """``(chunk_id, doc_id, domain, lang, title, text, embed_text, position, updated_at)``. The id hashes title and text,
    so unchanged text keeps it; text that an article repeats is kept once, at its first position. ``compose`` applies NFC
    (a pandas UDF); leave it out for texts known to be composed."""
    groups = articles.select("id", *FIELDS[1:], F.posexplode(packed(paragraphs(F.col("body")), limit)).alias("position", "group"))
    text = collapse(nfc("group") if compose else F.col("group"))
    placed = groups.select(F.col("id").alias("doc_id"), *FIELDS[1:], F.col("position").cast("long").alias("position"), text.alias("text"))
    digest = F.substr(F.sha2(F.concat_ws("\n", "title", "text"), 256), F.lit(1), F.lit(12))
    named = placed.withColumn("chunk_id", F.concat_ws("#", "doc_id", digest))
    first = F.row_number().over(Window.partitionBy("doc_id", "chunk_id").orderBy("position"))
    kept = named.withColumn("_n", first).where("_n = 1")
    return kept.select("chunk_id", "doc_id", "domain", "lang", "title", "text", F.concat_ws("\n\n", "title", "text").alias("embed_text"), "position", "updated_at")
