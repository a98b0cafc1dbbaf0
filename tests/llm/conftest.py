import pytest

EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, fp string, score string, words string, b0 string, lang_pred string, spans string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like outputs."""
    long = " ".join(f"word{i % 977} and the" for i in range(60_000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, "!!! ??? 123", "en", None, 11),
        (5, "x", "en", "a", 1),
        (6, long, "en", "a", len(long)),
        (7, "the same text of some words in a row", "en", "a", 36),
        (7, "the same text of some words in a row", "en", "a", 36),
        (8, "the same text of some words in a row", None, "b", 36),
        (None, "a text without an id that is long enough", "en", "b", 40),
        (9, "Ünïcödé 😀 ▁ \x00 text   end", "fr", "b", 27),
    ]
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x", "x") for r in rows], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
