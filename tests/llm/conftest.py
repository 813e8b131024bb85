import pytest

LONG = "Lorem ipsum dolor sit amet, consectetur " * 20_000

#: Nulls, empty and very long texts, repeated rows and ids.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "de", "a", 0),
    (4, LONG, "en", "b", 7),
    (5, "Grüße aus Köln,\n\n  das ist \t ein Text .", "de", None, 3),
    (5, "Grüße aus Köln,\n\n  das ist \t ein Text .", "de", None, 3),
    (None, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "b", 5),
    (7, " \n\t ...!!! ", "fr", "c", 9),
    (8, "MIT License CC-BY 4.0 apache license", "en", "a", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Awkward documents with columns whose names clash with those of results."""
    from pyspark.sql import functions as F

    extra = {c: F.lit("mine") for c in ("n_words", "labels", "score", "taken", "content", "_read", "key", "kept", "host", "_key", "_words", "_row")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(extra)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
