import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, equal texts, a long text, and clashing extra columns."""
    rows = [
        (None, None, None, None, None, 7, "x"), (1, "", "en", "a", 0, 7, "x"), (2, " \n\t ", None, "a", 4, 7, "x"),
        (3, "One  Two", "en", None, 8, 7, "x"), (3, "One  Two", "en", None, 8, 7, "x"), (4, "one two", "fr", "b", 7, 7, "x"),
        (5, "word " * 30_000, "en", "a", 150_000, 7, "x"), (6, "日本語 é à 🎉 " * 40, "und", "b", 400, 7, "x"), (7, "12 34 !?", "en", "a", 8, None, None),
    ]
    return spark.createDataFrame(rows, COLUMNS + ", score int, ids string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
