"""Cited answers from retrieved chunks, and when to ask back instead of routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import collapse, detect_script, question_language

#: Refusals by the question's language.
REFUSALS = {
    "en": "Sorry, I can't answer that from our help articles. Please contact our support team.",
    "deva": "माफ गर्नुहोस्, हाम्रा सहायता लेखहरूमा यसको जवाफ छैन। कृपया हाम्रो सपोर्ट टोलीलाई सम्पर्क गर्नुहोस्।",
    "roman": "Maaf garnuhola, hamro help article haru ma yasko jawaf chhaina. Kripaya hamro support team lai sampark garnuhos.",
}
#: Clarification questions, and what a customer of each domain would name.
UNCLEAR = "तपाईंको समस्या अलि खुलाएर भन्नुहोस् न: के भयो, कुन %smा, र कहिले? धेरै समस्या छन् भने कुनचाहिँ पहिले हेरौँ?"
CHOOSE = "तपाईंको समस्या यीमध्ये कुन हो: %s, कि %s? अलि खुलाएर भन्नुहोस् न।"
SUBJECTS = {"shop": "अर्डर", "wallet": "कारोबार", "bank": "खाता वा कारोबार"}
SCRIPTS = {"deva": "devanagari", "roman": "romanized", "mixed": "mixed"}


def _lookup(key: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def refusal(question: Column) -> Column:
    return _lookup(question_language(question), REFUSALS)


def script_name(text: Column) -> Column:
    return _lookup(detect_script(text), SCRIPTS)


def valid_citations(drafts: DataFrame, hits: DataFrame) -> DataFrame:
    """``(question_id, citations)``: the draft's citations, in order and once each, whose chunk was retrieved for that
    question and holds the quote, white space collapsed. Questions without one are absent."""
    cited = drafts.select("question_id", F.posexplode("citations").alias("at", "c"))
    cited = cited.select("question_id", "at", F.col("c.chunk_id").alias("chunk_id"), collapse(F.col("c.quote")).alias("quote")).where("quote <> ''")
    found = cited.join(hits.select("question_id", "chunk_id", "doc_id", "text"), ["question_id", "chunk_id"]).where(F.contains("text", "quote"))
    once = found.groupBy("question_id", "chunk_id", "doc_id", "quote").agg(F.min("at").alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", F.struct("chunk_id", "doc_id", "quote").alias("c"))))
    return once.groupBy("question_id").agg(F.transform(listed, lambda x: x["c"]).alias("citations"))


def respond(questions: DataFrame, hits: DataFrame, drafts: DataFrame, least: float) -> DataFrame:
    """``(question_id, answer, citations, refused, refusal_reason)`` of every question.

    Refusals, first that holds: low_similarity (no hit, or the best below ``least``), model_declined (the draft refuses or
    is missing), no_valid_citation (none, or an empty answer). questions: question_id, question. hits: question_id,
    chunk_id, doc_id, text, score. drafts: question_id, refused, answer, citations (chunk_id, quote)."""
    best = hits.groupBy("question_id").agg(F.max("score").alias("best"))
    joined = (
        questions.join(best, "question_id", "left")
        .join(drafts.select("question_id", F.col("refused").alias("_declined"), F.col("answer").alias("_draft")), "question_id", "left")
        .join(valid_citations(drafts, hits), "question_id", "left")
    )
    reason = (
        F.when(F.col("best").isNull() | (F.col("best") < least), "low_similarity")
        .when(F.coalesce("_declined", F.lit(True)), "model_declined")
        .when(F.col("citations").isNull() | (F.coalesce("_draft", F.lit("")) == ""), "no_valid_citation")
    )
    kept = F.when(reason.isNull(), F.col("citations")).otherwise(F.array().cast(drafts_type(joined)))
    return joined.select(
        "question_id",
        F.when(reason.isNull(), F.col("_draft")).otherwise(refusal(F.col("question"))).alias("answer"),
        kept.alias("citations"),
        reason.isNotNull().alias("refused"),
        reason.alias("refusal_reason"),
    )


def drafts_type(joined: DataFrame):
    return joined.schema["citations"].dataType


def extractive(hits: DataFrame) -> DataFrame:
    """Drafts without a model: the first sentence of each question's best hit, citing it (ties: least chunk id)."""
    best = hits.groupBy("question_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "chunk_id", "text")).alias("b"))
    sentence = F.regexp_extract(collapse(F.col("b.text")), r"^(.*?[.!?।])(?:\s|$)", 1)
    sentence = F.when(sentence == "", collapse(F.col("b.text"))).otherwise(sentence)
    cited = F.array(F.struct(F.col("b.chunk_id").alias("chunk_id"), sentence.alias("quote")))
    return best.select("question_id", F.lit(False).alias("refused"), sentence.alias("answer"), cited.alias("citations"))


def ranked(p: Column, names: list[str]) -> Column:
    """Categories by falling probability, earlier ones first among equals."""
    order = F.transform(p, lambda x, i: F.struct((-x).alias("p"), i.alias("i")))
    return F.transform(F.array_sort(order), lambda x: F.element_at(F.array(*map(F.lit, names)), x["i"] + 1))


def decide(clar: Column, conf: Column, p: Column, names: list[str], fallback: str, ask_from: float, least: float) -> Column:
    """Struct ``(needs_clarification, reason, options)``: unclear_message from ``ask_from`` on, low_confidence below
    ``least`` with the two likeliest categories but the fallback, else none."""
    reason = F.when(clar >= ask_from, "unclear_message").when(conf < least, "low_confidence")
    two = F.slice(F.filter(ranked(p, names), lambda c: c != fallback), 1, 2)
    return F.struct(reason.isNotNull().alias("needs_clarification"), reason.alias("reason"), F.when(reason == "low_confidence", two).alias("options"))


def clarifying_question(decision: Column, domain: Column, shown: dict[str, str]) -> Column:
    """The Devanagari question for a decision; ``shown`` gives the categories' names. Transliterate it for romanized texts."""
    name = lambda i: _lookup(F.get(decision["options"], F.lit(i)), shown)
    unclear = F.format_string(UNCLEAR, _lookup(domain, SUBJECTS))
    return F.when(decision["reason"] == "unclear_message", unclear).when(decision["reason"] == "low_confidence", F.format_string(CHOOSE, name(0), name(1)))


def act(clar: Column, conf: Column, ask_from: float, least: float) -> Column:
    """clarify, route or triage."""
    return F.when(clar >= ask_from, "clarify").when(conf >= least, "route").otherwise("triage")
