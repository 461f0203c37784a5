import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length int, start string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and clashing column names."""
    rows = [
        (1, None, None, None, None, 1, "x"),
        (None, "a text without an id", "en", None, 20, None, None),
        (2, "", "en", "s", 0, 2, None),
        (3, "word " * 30000, "en", "s", 150000, 3, ""),
        (4, "one two three four five six seven", None, "s", 33, 4, "y"),
        (4, "one two three four five six seven", None, "s", 33, 4, "y"),
        (5, "one two three four five six seven", "en", "t", 33, 5, "y"),
        (6, "x" * 60000, "en", "t", 60000, 5, "y"),
        (7, " \n\t\n ", "en", "t", 5, 5, "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
