import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of given texts; ids from 0."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)], DOC_SCHEMA)

    return make


ODD = [None, "", " ", "\n\n\n", "a", "A a", "x" * 50_000, "word " * 30_000, "same text here", "same text here", "é ß 中文 😀 \u0301", "\x00 nul", "a\t\x0bb\r\nc"]


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls, empty and very long texts, repeated rows and ids."""
    return docs_of(ODD + ["same text here", "tail"], [*range(len(ODD)), 8, None])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
