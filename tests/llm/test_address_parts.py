"""Parts of an address count with all their digits."""

from tablelens.llm import pii


def test_parts_of_many_digits(documents):
    texts = ["1000000001.2.3.4", "1.2.3.10000000000000000000", "0000000000255.2.3.4", "000000000000.0.0.0", "1.2.3.0000000000256"]
    rows = {r.doc_id: [m.value for m in r.pii.ip] for r in pii.find(documents(list(enumerate(texts)))).collect()}
    assert rows == {0: [], 1: [], 2: [texts[2]], 3: [texts[3]], 4: []}
