"""Corpus preparation: reject poor documents, drop near-duplicates, decontaminate, mix sources, shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import decontaminate, mixing, quality, sharding, simhash
from feedloom.llm.scratch import small_batches
from feedloom.llm.ship import shipping
from feedloom.operators.stages import written

SHARD_BYTES = 1 << 20


@shipping
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the rated ones among them."""
    with small_batches(spark):
        model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        return written(quality.scored(docs, model).where("_quality.kept").drop("_quality"))


@shipping
def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id."""
    return simhash.one_of_each(docs)


@shipping
def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@shipping
def keep_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that rake source, language and topic to their targets."""
    return mixing.mix(docs).where("_mix.kept").drop("_mix")


@shipping
def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    return sharding.assign_shards(docs, "doc_id", F.octet_length("text"), SHARD_BYTES)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_copy),
    ("benchmark decontamination", keep_clean),
    ("mixing sources to target weights", keep_mix),
    ("sharding", into_shards),
]

ORACLE_SQL = None  # a trained model and hashed shingles; tests hold the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
