import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return DATA


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text) of the smallest table."""
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in each column, empty and very long texts, repeated rows, and columns named as operators name theirs."""
    long_ = " ".join(f"word{i % 997}" for i in range(40_000))
    rows = [
        (1, "The quick brown fox's  jumping\n\n over it", "en", "a", 5), (1, "The quick brown fox's  jumping\n\n over it", "en", "a", 5),
        (2, None, "en", None, None), (3, "", None, "b", 0), (None, "no id here", "en", "c", 3), (None, None, None, None, None),
        (4, long_, "en", "a", 1), (5, long_, "en", "a", 1), (6, "   \n\t ", "fr", "a", 2), (7, "12345 !!! 678", "fr", "x", 2), (8, "\x00\x1c été 😀 ça", "fr", "x", 9),
        (2, "the second text of document two", "en", "z", 7),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = ["v", "key", "sig", "sum", "start", "length", "ids", "media", "title"]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
