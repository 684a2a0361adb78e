"""Sharding by jump consistent hashing (Lamping and Veach 2014).

A key walks through ever later shard numbers by draws of a linear congruential generator
that the key seeds, and stays where the next draw would lead past the last shard. No table
is kept, and with one more shard a key either stays or moves into the new shard.

Slots number the rows of a shard without gaps in the order of id, text digest and size:
one range shuffle of the small rows (never of texts), positions inside every written part,
and offsets from the counts of (part, shard).

Defined results: null ids share one key; null text has size 16 and the digest of empty
bytes; repeated rows get slots of their own; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turfline.llm.common import table
from turfline.session import settle

SHARDS = 40
#: Constants of the published algorithm.
STEP = np.uint64(2862933555777941757)
SPAN = float(1 << 31)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every unsigned 64-bit key."""
    state = keys.astype(np.uint64).copy()
    here = np.full(len(state), -1, np.int64)
    ahead = np.zeros(len(state), np.int64)
    walking = np.flatnonzero(ahead < shards)
    with np.errstate(over="ignore"):
        while len(walking):
            here[walking] = ahead[walking]
            state[walking] = state[walking] * STEP + np.uint64(1)
            draw = SPAN / ((state[walking] >> np.uint64(33)).astype(np.float64) + 1.0)
            ahead[walking] = np.floor((here[walking] + 1) * draw).astype(np.int64)
            walking = walking[ahead[walking] < shards]
    return here


def shard_of(key: Column, shards: int) -> Column:
    """Jump shard of a long column; null counts as key 0."""

    @F.pandas_udf("int")
    def assigned(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return assigned(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard of ``shards``, grown_shard of one more."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    return rows.withColumns(
        {"shard": shard_of(F.col("doc_id"), shards), "grown_shard": shard_of(F.col("doc_id"), shards + 1)}
    )


def _positions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the rows of each shard inside this task's part."""
    part, seen = TaskContext.get().partitionId(), {}
    for frame in frames:
        place = frame.groupby("shard").cumcount() + frame["shard"].map(lambda s: seen.get(s, 0))
        for shard, rows in frame["shard"].value_counts().items():
            seen[shard] = seen.get(shard, 0) + int(rows)
        yield frame.assign(part=part, place=place.astype("int64"))


def with_slots(assigned: DataFrame) -> DataFrame:
    """Add ``slot``: gapless from 0 in every shard, by id, then text digest, then size."""
    salted = settle(assigned.withColumn("salt", F.monotonically_increasing_id()), "shards")
    order = ["shard", "doc_id", "text_crc32", "size"]
    ranged = salted.repartitionByRange(*order, "salt").sortWithinPartitions(*order, "salt").drop("salt")
    kinds = ", ".join(f"{name} {kind}" for name, kind in ranged.dtypes)
    placed = settle(ranged.mapInPandas(_positions, f"{kinds}, part int, place long"), "slots")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    slotted = placed.join(starts, ["shard", "part"]).withColumn("slot", F.col("before") + F.col("place"))
    return slotted.drop("part", "place", "before")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with size, shard and grown_shard; columns of these names are replaced."""
    key = F.col("doc_id").cast("long")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    return docs.withColumns({"size": size, "shard": shard_of(key, shards), "grown_shard": shard_of(key, shards + 1)})


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write ``docs`` in one folder per shard, every task its own rows of each shard."""
    sharded(docs, shards).write.partitionBy("shard").parquet(path)


QUERY = "op7_jump_shards"


def query(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_slots(assign(table(spark, folder, "documents")))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


# The crc32 column has no SQL counterpart; the tests hold this query against brute force.
ORACLE_SQL = None
