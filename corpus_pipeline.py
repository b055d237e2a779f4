"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and
returns the columns of ``documents`` (the last one adds ``shard``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from epochal.llm.common import forget, materialise
from epochal.llm.decontaminate import decontaminate_stage
from epochal.llm.mixing import mix_stage
from epochal.llm.quality import quality_stage
from epochal.llm.sharding import shard_stage
from epochal.llm.simhash import dedup_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_stage(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_stage(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate_stage(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_stage(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_stage(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A trained classifier and fingerprints stand in the way of SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again; what a stage has read is deleted then,
    and the last one's table when the session ends."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        after = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(before)
        docs = before = after
    return docs
