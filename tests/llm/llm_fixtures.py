"""Fixtures of the corpus operators' tests."""

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Builds a documents table from (doc_id, text) pairs, with the other columns filled in."""

    def make(pairs):
        rows = [(key, text, "en", "src0", None if text is None else len(text)) for key, text in pairs]
        return spark.createDataFrame(rows, DOCUMENTS)

    return make
