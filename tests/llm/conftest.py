import random

import pytest

from .helpers import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside; documents may bring columns of the same names.
CLASHING = ["fp", "rep", "label", "size", "draw", "hash", "depth", "key", "at", "words", "shift", "n", "score", "prefix"]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(3)
    long = words(rng, 60_000)
    rows = [(1, None, None, None, None), (2, "", "en", "b", 0), (3, " \t\n", "en", None, 3),
            (4, "one two three four", "en", "a", 18), (5, "one two three four", "fr", "a", 18),
            (None, "one two three four", "en", "a", 18), (None, None, None, None, None),
            (6, long, "en", "a", len(long)), (7, long + " tail", "fr", "c", len(long) + 5),
            (8, "12345 67 89", None, "b", 11), (9, "éàü ñandú über", "es", "\u0000x", 14),
            (9, "éàü ñandú über", "es", "\u0000x", 14), (10, "x" * 200_000, "en", "b", 200_000),
            (11, "😀 😃 z", "en", "b", 5), (12, "0" * 50_000 + " @ +", "en", "b", 50_004)]
    rows += [(100 + i, words(rng, rng.randint(1, 60)), rng.choice(["en", "fr"]), rng.choice("abc"), 1) for i in range(60)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing_docs(spark, odd_docs):
    from pyspark.sql import functions as F
    return odd_docs.select("*", *[F.lit("own").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
