"""The corpus pipeline: documents in, documents dealt to shards out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; `run` writes
every stage's rows as Parquet to the shared folder and reads them back for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablescope.llm import cube, decontaminate, jump, quality, simhash
from tablescope.storage import materialize


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. A null text is empty and has too few words."""
    return quality.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies; rows without id stay."""
    return simhash.drop_near_copies(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document taken twice is two equal rows."""
    return cube.mix(docs)


def sharded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the shard that their id decides and their place in it."""
    return jump.deal(docs)


STAGES = [
    ("quality rules", good_documents),
    ("SimHash near-dedup", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("mixing sources", mixed_documents),
    ("sharding", sharded_documents),
]

# Fingerprints, balanced sampling and the order of a shard are beyond SQL: the tests hold each
# stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
