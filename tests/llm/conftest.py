import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, fp string, h string, ids string, words string, part string, kind string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and clashing names."""
    long = "the quick brown fox jumps over it " * 3000
    texts = [None, "", "   ", "x", long, "same text of a few words here", "same text of a few words here", "1234 5678", "Ünïcödé ß 日本語 🙂"]
    rows = [(i, t, "en" if i % 2 else None, None, None, *["c"] * 7) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "a null id", "fr", "s", 1, *[None] * 7)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
