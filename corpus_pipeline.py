"""From documents to shards: five stages, each one operator, each over all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs.  All but the last return the columns of documents; the last adds ``shard``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowsift.llm import decontaminate, mixing, quality, sharding, simhash
from rowsift.llm.common import remove, scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and host verdicts accept."""
    return quality.acceptable(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no span of 13 words with a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture asks for."""
    return mixing.remixed(docs, table(spark, sf_dir, "labels"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard of their group."""
    return sharding.sharded(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
    ("sharding", shards),
]

#: The mixing stage fits a classifier, which SQL can't express; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:  # what the stage read is written anew, so it is not needed any more
            remove(spark, before)
        before = f"{base}/{name}"
    return docs
