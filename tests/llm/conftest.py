import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} tail" for i in range(60_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "src0", 10),
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "src0", 10),
    (2, None, None, None, None),
    (3, "", "en", "src1", 0),
    (None, "a text without an id", "en", "src1", 5),
    (4, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "src0", 10),
    (5, LONG, "de", "src2", len(LONG)),
    (6, " \n\t ", "fr", "src2", 4),
    (7, "### $$$ !!!", "fr", "src1", 11),
    (None, None, None, None, None),
]


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty and long texts, repeated rows and columns of other names that operators use inside."""
    clash = {c: F.lit(1) for c in ("id", "n", "key", "a", "b", "count", "rate", "score", "stratum", "tokens", "copies", "copy_no", "shard", "hi", "lo", "digest", "licence", "match", "words", "part", "good")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(clash)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (5, 1, 1), (7, 0, 0), (None, 1, 0), (3, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
