"""A training corpus from documents: quality, near-dedup, decontamination, mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of the documents. What a stage hands on is written and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import staged, table
from folioforge.llm.decontam import decontaminated
from folioforge.llm.mixing import mixed_documents
from folioforge.llm.quality import KEEP, quality_model, quality_score
from folioforge.llm.sharding import shard_documents
from folioforge.llm.simhash import one_of_each

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labelled ones."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_score(F.col("text"), model) >= KEEP)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group."""
    return one_of_each(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it."""
    return mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it."""
    return shard_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_documents),
    ("simhash near-dedup", deduplicated),
    ("benchmark decontamination", clean_of_benchmarks),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
