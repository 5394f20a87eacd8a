"""Personal data (operator 3): regular expressions propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. Patterns are linear-time forms (possessive, anchored at the start of a run) of the plain ones,
so that a very long run of digits or letters costs no more than its length.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Kind(NamedTuple):
    """pattern: what proposes a span; guard: a cheap test that a text may hold one; prior: score of a proposal;
    words: what raises the score when it stands within NEAR characters."""

    name: str
    pattern: str
    guard: str
    prior: float
    words: str


#: Code points on either side of a span that are searched for context words.
NEAR = 48
#: What a context word adds, what a passed checksum adds, and the least score of a kind that is not part of the base.
CONTEXT, CHECKSUM, ENOUGH = 0.3, 0.3, 0.6
_LOCAL = "A-Za-z0-9._%+-"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
BASE = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.7, "mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", 0.5, r"\bip\b|server|host|address|adresse|direcci"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", "[0-9](?:[ -]?[0-9]){13}", 0.3, "card|visa|credit|payment|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.5, r"\btel|phone|call|mobile|fax|telefon|t.l.phone"),
)
#: Characters of an IBAN after its country code and two check digits, and the countries of each such length: those of the
#: registry, then those that use the form without being in it.
_IBAN = {
    11: "NO",
    12: "BE",
    14: "DK FK FO FI GL NL SD",
    15: "MK SI",
    16: "AT BA EE KZ LT LU XK MN",
    17: "HR LV LI CH",
    18: "BG BH CR DE GB GE IE ME RS VA",
    19: "AE GI IL IQ OM SO TL",
    20: "AD CZ MD PK RO SA SE SK ES TN VG",
    21: "LY PT ST AO CV GW MZ",
    22: "IS TR DZ IR",
    23: "BI DJ FR GR IT MC MR SM CF CG CM GA GQ KM MG TD",
    24: "AL AZ BY CY DO GT HN HU LB NI PL SV BF BJ CI MA ML NE SN TG",
    25: "BR EG PS QA UA",
    26: "JO KW MU YE",
    27: "MT SC",
    28: "LC",
    29: "RU",
}
_COUNTRIES = "|".join(" ".join(_IBAN.values()).split())
#: A known country fixes the length, so that what follows is no part of the span. Any other code is taken with the whole
#: run after it, up to an IBAN of a known country.
_IBANS = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}}(?![A-Za-z0-9])" for n, c in _IBAN.items())
_OTHER = rf"(?!{_COUNTRIES})[A-Z]{{2}}[0-9]{{2}}(?:(?: (?!(?:{_COUNTRIES})[0-9]{{2}}))?[A-Z0-9]){{11,30}}+(?![A-Za-z0-9])"
ADDED = (
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBANS}|{_OTHER})", "[A-Z]{2}[0-9]{2}", 0.4, "iban|bank|account|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-", 0.3, r"\bssn\b|social security|tax id"),
)
KINDS = BASE + ADDED


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def value(c: Column, i: Column) -> Column:
        n = F.ascii(c) - 48
        twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.when(i % 2 == 1, twice).otherwise(n)

    each = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's digits, its first four characters moved to the end and letters as 10 to 35, leave 1 by 97."""
    packed = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substr(packed, F.lit(5)), F.substr(packed, F.lit(1), F.lit(4)))

    def step(left: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, left * 10 + code - 48).otherwise(left * 100 + code - 55) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _confirmed(kind: Kind, value: Column) -> Column:
    """The kind's own test of a proposed span."""
    n = F.length(_digits(value))
    if kind.name == "ip":
        return F.forall(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "").rlike(f"^{_OCTET}$"))
    if kind.name == "card":
        return n.between(14, 19) & luhn(_digits(value))
    if kind.name == "phone":
        return n.between(10, 15)
    return mod97(value) if kind.name == "iban" else F.lit(True)


#: Pieces that a sum of lengths stands for; two levels of sums give any start in a few steps.
FAN = 64


def _lengths(kind: Kind) -> Column:
    """For each proposal, the code points from the end of the one before it to its own end."""
    matches, between = F.col(f"m_{kind.name}"), F.col(f"p_{kind.name}")
    return F.transform(matches, lambda m, i: F.length(F.get(between, i)) + F.length(m)).alias(f"l_{kind.name}")


def _total(lengths: Column, after: Column, n: Column) -> Column:
    return F.aggregate(F.slice(lengths, after + 1, n), F.lit(0), lambda a, x: a + x)


def _sums(lengths: str, name: str) -> Column:
    """Sums of each FAN of the lengths."""
    starts = F.when(F.size(lengths) > FAN, F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(FAN))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: _total(F.col(lengths), i, F.lit(FAN))).alias(name)


def _spans(kind: Kind, number: int) -> Column:
    """Confirmed spans as structs that sort by start, then kind. Starts are sums over what stands between and within the
    proposals, so positions count code points."""
    matches, between = F.col(f"m_{kind.name}"), F.col(f"p_{kind.name}")

    def span(value: Column, i: Column) -> Column:
        block = F.floor(i / FAN).cast("int")
        top = F.floor(i / (FAN * FAN)).cast("int")
        before = (
            _total(F.col(f"t_{kind.name}"), F.lit(0), top)
            + _total(F.col(f"b_{kind.name}"), top * FAN, block - top * FAN)
            + _total(F.col(f"l_{kind.name}"), block * FAN, i - block * FAN)
        )
        start = before + F.length(F.get(between, i))
        around = F.concat_ws(" ", F.right(F.get(between, i), F.lit(NEAR)), F.left(F.get(between, i + 1), F.lit(NEAR)))
        context = F.when(F.lower(around).rlike(kind.words), F.lit(CONTEXT)).otherwise(F.lit(0.0))
        checksum = CHECKSUM if kind.name in ("card", "iban") else 0.0
        return F.struct(
            start.alias("start"),
            F.lit(number).alias("number"),
            (start + F.length(value)).alias("end"),
            F.lit(kind.name).alias("kind"),
            F.least(F.lit(1.0), F.lit(kind.prior + checksum) + context).alias("score"),
        )

    # positions need every proposal; the test of each is looked up afterwards by its place
    placed = F.transform(matches, lambda m, i: F.struct(_confirmed(kind, m).alias("ok"), span(m, i).alias("span")))
    return F.transform(F.filter(placed, lambda x: x["ok"]), lambda x: x["span"])


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_iban, n_ssn, max_score, found)`` of every row.

    ``found`` is an array of (start, number, end, kind, score). Base kinds keep every confirmed span whatever its score;
    added kinds need ENOUGH. One output row per input row, repeated rows and null ids repeat; a null text counts as empty
    (no spans, the hash of the empty string, null ``max_score``); an empty table gives an empty result. Spans of one start
    stand in the order of KINDS. A very long text costs what its length does: patterns never go back, starts are sums of
    sums. Other columns are not read. No shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_t"))
    proposed = []
    for kind in KINDS:
        maybe = F.contains(F.col("_t"), F.lit("@")) if kind.guard == "@" else F.col("_t").rlike(kind.guard)
        none = F.array().cast("array<string>")
        proposed += [
            F.when(maybe, F.regexp_extract_all("_t", F.lit(kind.pattern), F.lit(0))).otherwise(none).alias(f"m_{kind.name}"),
            F.when(maybe, F.split("_t", kind.pattern, -1)).otherwise(none).alias(f"p_{kind.name}"),
        ]
    rows = rows.select(id_col, *proposed)
    # each level is read more than once, so that it is computed once a text and not once a span
    rows = rows.select("*", *map(_lengths, KINDS))
    rows = rows.select("*", *(_sums(f"l_{k.name}", f"b_{k.name}") for k in KINDS))
    rows = rows.select("*", *(_sums(f"b_{k.name}", f"t_{k.name}") for k in KINDS))
    rows = rows.select(id_col, *(_spans(k, i).alias(f"s_{k.name}") for i, k in enumerate(KINDS)))
    added = [F.filter(F.col(f"s_{k.name}"), lambda s: s["score"] >= ENOUGH) for k in ADDED]
    base = [F.col(f"s_{k.name}") for k in BASE]
    rows = rows.select(
        id_col,
        *(F.size(f"s_{k.name}").cast("long").alias(f"n_{k.name}") for k in BASE),
        *(F.size(a).cast("long").alias(f"n_{k.name}") for k, a in zip(ADDED, added)),
        F.array_sort(F.concat(*base)).alias("_base"),
        F.array_sort(F.concat(*base, *added)).alias("found"),
    )
    return rows.select(
        id_col,
        *(f"n_{k.name}" for k in BASE),
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        *(f"n_{k.name}" for k in ADDED),
        F.array_max(F.transform("found", lambda s: s["score"])).alias("max_score"),
        "found",
    )
