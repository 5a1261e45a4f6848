import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, repeated and very long texts, and columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again today", "x", 1),
        (2, None, None, None), (3, "", "x", 2), (None, "a text without an id", "x", 3), (4, "   \n\t ", "x", 3),
        (5, "same text", "x", 1), (5, "same text", "y", 1), (6, "same text", None, 1), (None, "same text", "z", 1),
        (7, long, "x", 1), (8, long + " more", "x", 1), (9, "one id two texts: first", "x", 1), (9, "one id two texts: second", "x", 1),
        (10, "é" * 9000, "x", 1), (-3, "a negative id with  odd\x0bspaces <|endoftext|> ", "x", 1),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, h string, kept int").withColumnRenamed("kept", "__k0")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, score double")
