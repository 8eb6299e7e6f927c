"""Account numbers end where their country says, whatever follows."""

from tablelens.llm import pii

NUMBERS = [
    "BE68 5390 0754 7034", "BE68539007547034", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "PL61 1090 1014 0000 0712 1981 2874",
    "SE45 5000 0000 0583 9825 7466", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S",
]


def test_what_follows_is_not_read(documents):
    after = ["", ", thanks", " EUR 50", " BIC X", " 1", " 12", " 123", " 1234", " ABCD", " A1", " BE68 5390 0754 7034"]
    texts = [f"pay {n}{a}" for n in NUMBERS for a in after]
    rows = {r.doc_id: r for r in pii.find(documents(list(enumerate(texts)))).collect()}
    for k, text in enumerate(texts):
        number, follows = NUMBERS[k // len(after)], after[k % len(after)]
        assert [m.value for m in rows[k].pii.iban] == [number] + [follows.strip()] * (" BE" in follows), text
    assert "EUR 50" in pii.redact(documents([(1, texts[2])])).first().text and "5390" not in pii.redact(documents([(1, texts[2])])).first().text


def test_no_account_numbers(documents):
    texts = ["BE68 5390 0754 7035 EUR", "xBE68 5390 0754 7034", "BE68 5390 0754 7034x", "BE68 5390 0754"]
    assert all(not r.pii.iban for r in pii.find(documents(list(enumerate(texts)))).collect())


def test_a_number_after_one_of_no_known_country(documents):
    found = pii.find(documents([(1, "ZZ12 3456 7890 BE68 5390 0754 7034 EUR")])).first().pii.iban
    assert [m.value for m in found] == ["BE68 5390 0754 7034"]
