import os

import pytest
from pyspark.sql import functions as F

SF = os.environ.get("FLOWLAB_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


#: Every awkward text: none, empty, white space, one word, punctuation, repeated rows, no id, a very long text.
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "word"), (5, "... --- !!"), (6, "a b c d e f g h i j k l"), (6, "a b c d e f g h i j k l"), (7, "A B c d e f g h i j k l"),
    (None, "a text without an id has words too, quite a few of them"), (8, "Ünï cödé ñandú 東京 😀 é  x y z"), (9, "same line here\n" * 5), (10, "lorem ipsum dolor " * 30_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows beside columns whose names the operators use themselves."""
    base = spark.createDataFrame(ODD, "doc_id long, text string")
    clash = ["row", "label", "score", "kept", "n_words", "component_id", "fp", "spans", "mentions", "chunk", "part", "ids", "train", "clean", "rule", "row_no", "shard"]
    return base.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"), *[F.lit(i).alias(c) for i, c in enumerate(clash)])


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    """Labels of the odd rows, with nulls, repeats and contradictions."""
    return spark.createDataFrame([(4, 1, 0), (4, 0, 1), (5, None, None), (None, 0, 1), (6, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
