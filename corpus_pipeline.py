"""A training corpus in five stages, each written and read again before the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  All
but the last keep the columns of documents; the last returns the sharding plan of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, language, mixing, sharding, simhash
from millrace.llm.shared import write_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learns from the lang column of docs."""
    return language.keep_known_languages(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; items of under decontaminate.LEAST tokens drop none."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least=decontaminate.LEAST)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources reach their targets."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mixture."""
    return sharding.shard_plan(docs)


STAGES = [("language", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixture), ("sharding", shards)]

#: Learned language bounds and XXH64 fingerprints have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
