"""The corpus pipeline: raw documents to mixed, sharded training rows.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir),
works on all that the stage before kept, and returns documents with the columns
it got (the last one adds the shard columns).  ``run`` applies them in order.
Every stage but the last two filters whole rows; mixing also repeats rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinder.llm import decontaminate, langid, mixing, sharding, simhash
from cinder.llm.common import documents, table
from cinder.session import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts in which no language is found."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave one document of each SimHash component."""
    return simhash.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    benchmark = table(spark, sf_dir, "benchmark")
    return decontaminate.keep_without_short(decontaminate.keep_clean(docs, benchmark), benchmark)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that every source meets its target."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the shard of each row."""
    return sharding.sharded(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

# Prediction by partial matching and the knapsack are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
