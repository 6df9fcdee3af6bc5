import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_docs(spark):
    """Null and empty texts, a null id, repeated rows, equal texts, and a column that clashes with names within operators."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, "a b c d e f g"), (2, None), (3, ""), (4, "a b c d e f g"), (4, "a b c d e f g"), (None, "x y"), (7, "x y"), (8, long), (9, long + " end"), (10, " \n "), (11, "ﬁne  Straße É"), (12, "fine STRASSE é")]
    return spark.createDataFrame([(i, t, "blob", "n", 0, b"\0") for i, t in rows], "doc_id long, text string, blob string, node string, hash long, digest binary")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
