"""Text functions as column expressions: normal forms, words, script, negation, amounts."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEVANAGARI_DIGITS, ASCII_DIGITS = "०१२३४५६७८९", "0123456789"
#: Word lists and endings that tell Nepali from Hindi and mark negation.
NEPALI_DEVA = "छ छैन मा भयो भो मेरो मैले लाई बाट गर्ने हो होइन पनि अनि तर भएको गरें गरेँ आयो आएन हुँदैन कसरी कति अझै गर्नुस् गरिदिनु चाहिँ त न रैछ छु".split()
HINDI_DEVA = "है हैं नहीं मेरा मेरे मेरी का की लिए गया गई हुआ रहा रही और क्या आप जल्दी लेकिन अभी बहुत क्योंकि चाहिए मुझे हमें करना करें कीजिए वाला थी".split()
NEPALI_ROMAN = (
    "cha chha xa chaina chhaina xaina ma bhayo vayo bho mero maile lai bata garne garna tara ani pani ni ho haina aayo ayo katyo katiyo "
    "hudaina kasari kati ajhai ajai garnus garnu vako bhako vaxa raixa khata milxa milcha hunxa k aako gareko pugena"
).split()
HINDI_ROMAN = (
    "nahi nahin mera mere meri kya gaya gayi hua raha rahi hoga karo kijiye aur hai hain pehle pehli pehla bhi lekin mujhe abhi kyunki "
    "kyun karna karein aap apna mein"
).split()
NEGATIONS = (
    "छैन होइन हैन नाइँ नगरेको हुँदैन आएन पुगेन निस्केन दिएनन् नभएको आउँदैन खुल्दैन मिल्दैन चाहिँदैन chaina chhaina xaina haina hoina hudaina aayena "
    "ayena aaena pugena pugyena bhaena niskena dienan vayena bhayena audaina aaudaina khuldaina mildaina nagareko navako not no never "
    "didn't didnt dont don't"
).split()
NEPALI_DEVA_END = "[ऀ-ॣ०-ॿ]{2,}(मा|लाई|बाट|सँग|ले|को|दैन|्छ|्छु|्छन्|छन्|एँ|ेँ|ें|यो|ियो|्यो|एको|ेको|ाको|इसक्यो|ेछ|एन|ेन|ैन|नुस्|ुहोस्|िदिनु)$"
NEPALI_ROMAN_END = r"[\p{L}\p{N}_]{2,}(xa|chha|xaina|chaina|chhaina|eko|yeko|ena|yena|daina|nus|nuhos|raixa|sakyo)$"
NEGATION_DEVA = "^(?:.+(?:एन|ेन|ैन|दैन|ैनन्|ेनन्|एनन्|िनँ)|न[ऀ-ॿ]+(?:को|ने|ई|एर|ेर|ी|का))$"
NEGATION_ROMAN = "^(?:.+(?:aina|ena|daina|ainan|enan)|na[a-z]+(?:ko|ne|i|era|kai))$"
WORD = r"[\p{L}\p{N}_ऀ-ॣ०-ॿ'‌‍]+"


def by_text(change: Callable[[str], str], texts: pa.Array) -> pa.Array:
    """``change`` of each text; null stays null. Only a few texts at once are objects of Python."""
    some = [pa.array([None if t is None else change(t) for t in texts[i : i + 64].to_pylist()], pa.string()) for i in range(0, len(texts), 64)]
    return pa.concat_arrays(some) if some else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def nfc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Unicode composition, which no built-in function offers."""
    for texts in batches:
        yield by_text(lambda t: unicodedata.normalize("NFC", t), texts)


def ascii_bounds(pattern: str) -> str:
    r"""A pattern whose \b are ends of words of ASCII letters, digits and underscores, as SQL takes them; Java's count letters
    of all scripts."""
    return pattern.replace(r"\b", r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")


def composed(text: Column) -> Column:
    """The composed form (NFC) of a text. Texts of characters below U+0300 are composed already and stay in the JVM."""
    return F.coalesce(nfc(F.when(text.rlike("[^\\x{0}-\\x{2FF}]"), text)), text)


def normal(text: str) -> str:
    """``normalize`` of a constant."""
    low = unicodedata.normalize("NFC", text).lower().translate(str.maketrans(DEVANAGARI_DIGITS, ASCII_DIGITS))
    return " ".join("".join(c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in low).split())


def normalize(text: Column) -> Column:
    """Composed, in lower case, with ASCII digits, everything but letters, digits and underscores to single blanks, trimmed."""
    t = F.translate(F.lower(composed(text)), DEVANAGARI_DIGITS, ASCII_DIGITS)
    return F.trim(F.regexp_replace(t, r"[^A-Za-z0-9_\p{L}\p{N}]+", " "))


def content_hash(text: Column) -> Column:
    return F.substr(F.sha2(normalize(text), 256), F.lit(1), F.lit(16))


def collapse(text: Column) -> Column:
    """White space collapsed, case kept: the comparison form of articles and quotes."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def detect_script(text: Column) -> Column:
    """deva, roman, or mixed, by the letters of a text; roman without letters."""
    deva, latin = text.rlike("[ऀ-ॣॱ-ॿ]"), text.rlike("[A-Za-z]")
    return F.when(deva & latin, "mixed").when(deva, "deva").otherwise("roman")


def _in(word: Column, values: list[str]) -> Column:
    return word.isin(values)


def nepali_markers(text: Column, script: str, of: Column | None = None) -> Column:
    """``of``, here and below, is a column of the text's words, where there is one: to find them costs most."""
    lexicon, ending = (NEPALI_DEVA, NEPALI_DEVA_END) if script == "deva" else (NEPALI_ROMAN, NEPALI_ROMAN_END)
    return F.size(F.filter(words(text) if of is None else of, lambda w: _in(w, lexicon) | w.rlike(f"^{ending}")))


def hindi_markers(text: Column, script: str, of: Column | None = None) -> Column:
    return F.size(F.filter(words(text) if of is None else of, lambda w: _in(w, HINDI_DEVA if script == "deva" else HINDI_ROMAN)))


def has_negation(text: Column, of: Column | None = None) -> Column:
    return F.exists(words(text) if of is None else of, lambda w: _in(w, NEGATIONS) | w.rlike(NEGATION_DEVA) | w.rlike(NEGATION_ROMAN))


def question_language(text: Column, of: Column | None = None, roman: Column | None = None) -> Column:
    """deva for Devanagari or mixed texts, roman for Latin ones with a Nepali marker, else en. ``roman``: the number of
    those markers, where it is known."""
    roman = nepali_markers(text, "roman", of) if roman is None else roman
    return F.when(detect_script(text) != "roman", "deva").when(roman > 0, "roman").otherwise("en")


#: What an amount looks like, and what stands for thousands and lakhs.
THOUSANDS = r"([0-9]+(?:\.[0-9]+)?)\s*(?:k\b|hajar\b|hazar\b|हजार)"
LAKHS = r"([0-9]+(?:\.[0-9]+)?)\s*(?:lakh\b|lac\b|लाख)"
AMOUNT = r"[0-9][0-9,]*(?:\.[0-9]+)?"


def amounts_in(text: Column) -> Column:
    """The distinct amounts of a text in rupees: plain numbers, thousands (k, hajar) and lakhs."""
    t = F.lower(F.translate(text, DEVANAGARI_DIGITS, ASCII_DIGITS))
    number = lambda s: F.round(F.replace(s, F.lit(","), F.lit("")).cast("double"), 2)
    found = lambda p, g: F.regexp_extract_all(t, F.lit(ascii_bounds(p)), F.lit(g))
    thousand = F.transform(found(THOUSANDS, 1), lambda s: F.round(number(s) * 1000, 2))
    lakh = F.transform(found(LAKHS, 1), lambda s: F.round(number(s) * 100000, 2))
    plain = F.transform(found(AMOUNT, 0), number)
    return F.array_sort(F.array_distinct(F.concat(plain, thousand, lakh)))


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"\s+"), ""))


def length_bucket(text: Column) -> Column:
    n = n_words(text)
    return F.when(n <= 12, "short").when(n <= 30, "medium").otherwise("long")


def neutralise(text: Column) -> Column:
    """Delimiter tokens of model inputs made harmless."""
    return F.regexp_replace(text, r"<\|([^|]*)\|>", "<¦$1¦>")
