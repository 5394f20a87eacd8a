"""Lines that differ in typographic punctuation or white space only are equal."""

import pytest

from granary.llm import line_dedup

PAIRS = [
    ("C'est l'avis de l'auteur sur la question du jour", "C’est l’avis de l’auteur sur la question du jour"),
    ('they said "come in" and closed the door', "they said “come in” and closed the door"),
    ("one two - three four five", "one two — three four five"),
    ("on dit << bonjour >> à tous les gens...", "on dit « bonjour » à tous les gens…"),
    ("dix mille francs pour tout le monde", "dix mille francs pour tout le monde"),
]


@pytest.mark.parametrize("plain, typographic", PAIRS)
def test_words_are_equal(plain, typographic):
    assert line_dedup.normalised(plain) == line_dedup.normalised(typographic)


def test_letters_and_marks_stay():
    assert [b.decode() for b in line_dedup.normalised("नमस्ते दुनिया, ÉTÉ été x²")[0]] == ["नमस्ते", "दुनिया", "été", "été", "x²"]
    assert len(line_dedup.normalised("a b\nc\x85d")) == 2


def test_copies_go(spark):
    docs = spark.createDataFrame([(2 * k + i, x) for k, pair in enumerate(PAIRS) for i, x in enumerate(pair)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs).selectExpr("row.doc_id", "n_removed").collect()}
    assert got == {i: i % 2 for i in range(2 * len(PAIRS))}
