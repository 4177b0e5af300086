"""A training-data pipeline of five operators over the table `documents`.

Each stage reads what its predecessor wrote to the shared folder, and all of it.  All but
the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import decontam, mixing, ngramjoin, sharding, toxicity
from logloom.llm.common import batches_of, stored

#: Of the texts that go to Python at a time; the rows of a batch that is being made and of the one in use are both held.
BATCH = "4m"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, that with the smallest id."""
    return ngramjoin.keep_one(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, each as often as the mix takes it."""
    return mixing.curriculum(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard."""
    return sharding.assign_shards(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", join_near_copies),
    ("benchmark_decontamination", remove_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The toxicity model, the chosen-path join and the edit distances are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with batches_of(spark, BATCH):
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
