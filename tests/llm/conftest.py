import pytest

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Makes a table of documents from (doc_id, text) or whole rows, with an extra column if asked."""

    def make(rows, extra=None):
        full = [r if len(r) == 5 else (r[0], r[1], "en", "src0", len(r[1] or "")) for r in rows]
        if extra:
            return spark.createDataFrame([(*r, "x") for r in full], f"{DOCUMENT}, {extra} string")
        return spark.createDataFrame(full, DOCUMENT)

    return make
