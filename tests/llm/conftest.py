import os

import pytest

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with everything that may come: null and empty texts, repeated rows, a null
    and a repeated id, white space only, characters beyond the BMP, and columns whose names
    the operators use inside."""
    long = " ".join(f"word{i % 701}" for i in range(30_000))
    rows = [
        (1, "Same text as the next one, word by word.", "en", "a"),
        (2, "Same text as the next one, word by word.", "en", "a"),
        (2, "Same text as the next one, word by word.", "en", "a"),
        (3, None, None, None),
        (4, "", "en", "b"),
        (5, " \n\t ", "en", "b"),
        (None, "A document without an id has a text like any other.", "de", None),
        (6, long, "fr", "a"),
        (7, "\U0001F600 café naïve 你好 <|endoftext|> end", "fr", "a"),
        (8, "one", "en", "a"),
        (9, "first text of nine", "en", "a"),
        (9, "second text of nine", "en", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    clashing = ["row", "n", "label", "score", "shard", "node", "hub", "ids", "part", "words", "phrase", "set_id", "version"]
    return df.select("*", *(F.lit("x").alias(c) for c in clashing))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
