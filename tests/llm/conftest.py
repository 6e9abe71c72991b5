import pytest
from pyspark.sql import functions as F

CLASHING = ("quality", "scored", "middle", "top", "most", "takes", "take", "model", "row", "position", "slot", "bits", "kept", "component_id", "block", "token", "findings")


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with every kind of oddity: nulls in any column, empty and long texts, ties, repeated rows, clashing columns."""
    words = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35, "x"),
        (2, "alpha beta gamma delta epsilon zeta", "en", "a", 35, None),
        (2, "alpha beta gamma delta epsilon zeta", "en", "a", 35, None),
        (3, None, "en", "b", None, "x"),
        (4, "", None, None, 0, "x"),
        (5, " \t\n ", "de", "b", 4, "x"),
        (6, words, "en", "c", len(words), "x"),
        (7, "one two", "fr", None, 7, "x"),
        (None, "no id here at all, really none", "en", "a", 30, "x"),
        (8, "ALPHA beta gamma delta ſté \U0001f600 end", None, "é", 30, "x"),
    ]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    # names that operators give to columns of their own
    return out.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
