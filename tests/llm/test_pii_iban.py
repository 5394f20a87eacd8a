"""IBANs are found whatever stands after them."""

import pytest

from granary.llm import pii

#: Specimens of the registry; their check digits are right.
GOOD = ["DE89370400440532013000", "GB29NWBK60161331926819", "NO9386011117947", "FR1420041010050500013M02606", "MT84MALT011000012345MTLCAST001S", "CH9300762011623852957", "BE68539007547034"]
AFTER = ["", " Bitte", " BITTE ZAHLEN", " 12 Euro", " BIC COBADEFF", " COBADEFFXXX", ", danke", ".", " DE", "\nBIC", " 1"]


def test_every_iban_is_found(spark):
    texts, want = [], []
    for k, code in enumerate(GOOD):
        for shown in (code, " ".join(code[i : i + 4] for i in range(0, len(code), 4))):
            other = GOOD[k - 1]
            texts += [f"Konto {shown}{after}" for after in AFTER] + [f"Konto {shown} {other}", f"Room AB12 {shown}", f"Konto x{shown}", f"Konto {shown}x"]
            here = (6, 6 + len(shown))
            want += [[here]] * len(AFTER) + [[here, (here[1] + 1, here[1] + 1 + len(other))], [(10, 10 + len(shown))], [], []]
    wrong = GOOD[0][:-1] + "1"
    texts += [f"Konto {wrong} Bitte", "Konto " + "AB12" + "C" * 60_000, "Konto DE12" + " 1234" * 20_000]
    want += [[], [], []]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_personal_data(docs).collect():
        got = [(s["start"], s["end"]) for s in r["found"] if s["kind"] == "iban"]
        assert got == want[r["doc_id"]] and r["n_iban"] == len(got), texts[r["doc_id"]][:80]


@pytest.mark.parametrize("code", GOOD)
def test_lengths_of_the_registry(code):
    assert next(n for n, c in pii._IBAN.items() if code[:2] in c.split()) == len(code) - 4
