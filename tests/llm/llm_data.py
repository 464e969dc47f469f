"""Fixtures of the operator tests."""

import pytest

SMALL = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, text_id string, fp int, score string, value int, label string, w int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """(doc_id, text[, lang]) rows as a documents table with further columns whose names clash with the operators' own."""
    from mailprism.session import local_table

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "a/b.txt", len(r[1] or ""), "k", "t", 1, "s", 2, "l", 3) for r in rows]
        return local_table(spark, full, DOCS)

    return make


@pytest.fixture(scope="session")
def frame(spark):
    from mailprism.session import local_table

    return lambda rows, schema: local_table(spark, rows, schema)


EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "word"), (5, "the same text as another"), (6, "the same text as another"),
         (6, "the same text as another"), (None, "a row without an id"), (None, None), (7, "é ñ ß 漢字 \U0001f600 idiot"),
         (8, "long " * 40_000), (9, "x" * 30_000), (2**60 + 1, "an id beyond the exact floats")]


@pytest.fixture(scope="session")
def edges(docs_of):
    return docs_of(EDGES)


@pytest.fixture(scope="session")
def nothing(docs_of):
    return docs_of(EDGES).where("false")
