import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with inner ones."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n", None, "a"), (4, "one two three", "en", "b"), (4, "one two three", "en", "b"), (5, "ONE two\tthree", "en", "b"),
        (6, long, "en", "a"), (7, long + " end", "en", None), (None, "text without an id at all", "en", "a"), (8, "12 34 !!", "de", "c"), (9, "a b c d", "fr", "c"), (10, "a b c d e", "fr", "c"),
    ]
    rows = [(*r, 1, "x", "y", "z", 2.0, "q") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, key string, doc string, row string, score double, c1 string")
