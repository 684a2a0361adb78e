"""Table layout, sinks and file audits."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns cast to a fixed contract; absent ones become typed nulls."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def write_table(df: DataFrame, path: str, key: str, partition_by: Sequence[str] = (), files: int | None = None) -> None:
    """Parquet with zstd, rows of a file ordered by key.

    A range split on the key keeps files even when one partition value is hot; no
    total order of the table is built on one task.
    """
    by = [*partition_by, key]
    spread = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    writer = spread.sortWithinPartitions(*by).write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The whole layout as one table; partition filters prune folders."""
    return spark.read.schema(schema).parquet(path)


def register_profile_views(profiles: DataFrame, features: Sequence[str]) -> None:
    """A10: season, feature and eligibility views over one profile table."""
    keys = ["scope", "player_id"]
    profiles.select(*keys, "minutes", "appearances", "role_family").createOrReplaceTempView("player_season")
    profiles.select(*keys, *features).createOrReplaceTempView("profile_features")
    profiles.select(*keys, "common_ready", "exclusion_reasons").createOrReplaceTempView("eligibility")


def write_sharded_json(df: DataFrame, path: str, key: str) -> None:
    """Detail records in folders named by the last two digits of the key."""
    shard = F.lpad(F.right(F.regexp_replace(F.col(key).cast("string"), r"\D", ""), F.lit(2)), 2, "0")
    df.withColumn("shard", shard).repartition("shard", F.pmod(F.xxhash64(key), F.lit(8))).write.mode(
        "overwrite"
    ).partitionBy("shard").json(path)


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        F.regexp_replace("path", f"^.*{re.escape(path.rstrip('/'))}/", "").alias("file"),
        F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("bytes"),
    )


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per output table."""
    parts = None
    for name, df in tables.items():
        part = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def audit_files(found: DataFrame, lock: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or different from the lock table."""
    want = lock.select("file", F.col("sha256").alias("expected"))
    both = want.join(found.select("file", "sha256"), "file", "full_outer")
    problem = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("expected").isNull(), "unexpected")
        .when(F.col("sha256") != F.col("expected"), "changed")
    )
    return both.select("file", problem.alias("problem")).where(F.col("problem").isNotNull())
