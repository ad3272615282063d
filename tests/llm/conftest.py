import pytest

from ..conftest import SMALL

#: Columns an operator might use for itself, in a table that has them already.
CLASHING = ["n_words", "shard", "slot", "_group", "_unit", "rejected_by", "key", "row", "spans",
            "wanted", "plan", "node", "label", "term", "data", "digest"]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


def sentence(seed: int, n: int) -> str:
    """n words that no other seed has."""
    return " ".join(f"w{seed}x{i}" for i in range(n))


LONG = sentence(1, 40_000)
ROWS = [
    (1, sentence(2, 60), "a"), (1, sentence(2, 60), "a"), (2, sentence(2, 60), "b"),
    (3, "", "a"), (4, None, None), (5, LONG, "b"), (6, LONG + " tail", None), (None, "x y z", "a"),
    (None, None, None), (7, " \t\n\x0b\f\r ", "a"), (8, "Été naïve \U0001f600 ok", "c"),
    (9, sentence(3, 100), "a"), (10, sentence(3, 100), "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with clashing names."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    df = df.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(7) for c in CLASHING}).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
