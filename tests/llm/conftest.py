"""Helpers of the tests of these operators."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Make a table of documents from texts (ids from 0 on) or from ``(id, text)`` pairs."""

    def make(texts, lang="en"):
        rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, lang, "s", len(t) if t is not None else None) for i, t in rows], SCHEMA)

    return make

