import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, or from ``(doc_id, text)`` pairs."""

    def make(*items):
        pairs = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(items)]
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], DOCS)

    return make
