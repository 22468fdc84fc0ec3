import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or wider rows, with a column whose name clashes."""

    def make(rows, schema="doc_id long, text string, lang string, source string"):
        width = len(schema.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return make


ODD = [(1, None), (2, ""), (3, "  \t\n "), (4, "a"), (5, "Same text here"), (5, "Same text here"), (6, "Same text here"),
       (None, "Same text here"), (7, "ÀÉÎ 日本語 \U0001f600 mixed"), (8, "word " * 20000), (9, "x" * 50000)]


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and very long texts, repeated rows."""
    return docs_of(ODD)


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of([])
