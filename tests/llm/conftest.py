"""Small tables with the awkward cases that every operator must take."""

import pytest

LONG = " ".join(f"word{i % 977}" for i in range(60_000))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and white texts, ties, repeated rows, a very long text and extra
    columns named like the operators' own."""
    rows = [(1, "The cat sat on the mat and looked at the dog in the yard", "en", "a", 10), (2, None, None, None, None), (3, "", "en", "a", 0),
            (4, " \t\n ", "en", "b", 4), (5, "One", "en", "b", 3), (5, "One", "en", "b", 3), (None, "One", None, "b", 3), (None, None, None, None, None),
            (6, "The cat sat on the mat and looked at the dog in the yard", "en", "a", 10), (7, LONG, "en", "c", len(LONG)), (8, "é ü ß 漢字 \U0001f600 é", "xx", "c", 9)]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
            .selectExpr("*", "'x' AS score", "7 AS shard", "8 AS node", "'n' AS id", "9 AS piece"))


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")
