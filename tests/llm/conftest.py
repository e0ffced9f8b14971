import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names the operators use too."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
        (2, "The QUICK brown fox jumps over the lazy dog again and again", "en", "a", 1),
        (2, "The QUICK brown fox jumps over the lazy dog again and again", "en", "a", 1),
        (3, None, None, None, None),
        (None, "no id here", "en", None, 3),
        (None, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \t\n ", "en", "b", 0),
        (6, "one", "en", "b", 0),
        (7, "two words", "en", "c", 0),
        (8, "Ünï cödé 漢字 " * 3, "xx", "é", 0),
        (9, "word " * 40_000, "en", "b", 0),
        (10, "\n\n\n", "en", "b", 0),
        (5, "another text under a used id", "en", "b", 0),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    from pyspark.sql import functions as F

    names = ["id", "fp", "k", "a", "b", "u", "v", "row", "size", "shard", "slot", "k0", "_part", "score", "part", "mark", "block", "n", "h", "cell", "tick", "copies", "toxic"]
    return odd_docs.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
