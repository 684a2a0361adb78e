"""Corpus pipeline: quality, near duplicates, benchmark leaks, mixing, sharding.

Every stage takes (spark, docs, folder) and returns a frame over all rows that the stage
before it kept; each is written as Parquet and read again. All but the last return the
columns of ``documents`` unchanged; the last adds the shard. Rows are repeated where the mix takes a document twice.

Near duplicates are documents of similarity 0.8 or more on shingles of five words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.llm import circulant_minhash, jump_shards, quality_classifier, template_leaks, water_filling
from turfline.llm.common import table
from turfline.session import settle


def keep_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, predicts as good."""
    model = quality_classifier.fit(docs, table(spark, folder, "labels"))
    return docs.where(quality_classifier.score(model, F.col("text")) >= 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return circulant_minhash.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item, also not with other numbers or names."""
    return template_leaks.decontaminated(docs, table(spark, folder, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document as often as the capped mix of sources takes it."""
    return water_filling.mixed_rows(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every row of the mix with its size and shard, and the shard it has once there is one more."""
    return jump_shards.sharded(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]
# The classifier's scores have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, folder), f"pipeline-{name}")
    return docs
