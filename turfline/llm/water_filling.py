"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Every source asks for its weight's share of ``share`` times all words. A source that would
be taken more than ``epochs`` times is clamped there and its excess goes to the others in
proportion to their weights, until none is above: target = min(cap, level * weight) with
one level for all unclamped sources. Inside a source the target is met by whole repetitions
of all its documents and one more repetition of a seeded random subset: documents in the
order of a seeded digest, until the words left are used up (to half a document).

Weights ``(5, 2, 1)`` repeat over the sources in code point order, null last.

Defined results: null text has size 0 and is taken 0 words; a source without words has
target 0; rows equal in id and text share a digest, so they are taken alike; null ids are
told apart by their texts; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turfline.llm.common import WHITE, table
from turfline.session import settle

SEED = 17
SHARE, EPOCHS, WEIGHTS = 1.5, 2, (5, 2, 1)


def words() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WHITE)), F.lit(0)).cast("long")


def digest(seed: int) -> Column:
    """Order of the documents of a source: a digest of seed, id and text."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}|"), own, F.lit("|"), F.md5(F.coalesce("text", F.lit("")))).cast("binary"))


def source_key() -> Column:
    """Source as a key that is never null and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t"))


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source_key, size, digest) of every row."""
    return docs.select("doc_id", source_key().alias("source_key"), words().alias("size"), digest(seed).alias("digest"))


def targets(sizes: DataFrame, share: float, epochs: int, weights: tuple[float, ...]) -> DataFrame:
    """One row per source: source_key, source_size, target. The level comes from running sums
    over the sources in the order in which they reach their caps."""
    totals = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy("source_key"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = totals.withColumn("weight", F.element_at(listed, ((place - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * float(epochs))
    everything = W.partitionBy()
    before = W.orderBy(F.col("cap") / F.col("weight"), "source_key").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0.0)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), zero)
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)
    levels = weighed.withColumn("level", left / open_weight)
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return levels.select(
        "source_key", "source_size", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target")
    )


def mixture_plan(sizes: DataFrame, share: float, epochs: int, weights: tuple[float, ...]) -> DataFrame:
    """One row per source: what ``targets`` says, ``whole`` repetitions of every document and
    ``until``, the last digest of the documents that are taken once more.

    The digests are cut into 4,096 ranges per source. Their sums find the range in which the
    words run out; only that range is put in order, so a source that holds most of the rows
    is no single group.
    """
    plan = targets(sizes, share, epochs, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = plan.withColumn("whole", whole)
    plan = settle(plan.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    ranged = sizes.withColumn("range", F.substring("digest", 1, 3))
    sums = ranged.groupBy("source_key", "range").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("source_key").orderBy("range"))
    edge = (
        sums.withColumn("upto", upto)
        .join(plan.select("source_key", "left"), "source_key")
        .where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("words") < F.col("left")))
        .select("source_key", "range", "left", (F.col("upto") - F.col("words")).alias("before"))
    )
    edge = settle(edge, "edges")
    in_order = W.partitionBy("source_key").orderBy("digest", "size").rowsBetween(W.unboundedPreceding, 0)
    inside = ranged.join(edge, ["source_key", "range"]).withColumn("reached", F.col("before") + F.sum("size").over(in_order))
    fits = F.col("reached") - F.col("size") / 2 <= F.col("left")
    last = inside.groupBy("source_key").agg(F.max(F.when(fits, F.col("digest"))).alias("last"), F.max("range").alias("range"))
    until = last.select("source_key", F.coalesce("last", "range").alias("until"))
    return settle(plan.join(until, "source_key", "left").drop("left"), "mixture")


def repetitions() -> Column:
    return F.col("whole") + F.coalesce(F.col("digest") <= F.col("until"), F.lit(False)).cast("int")


def mix(
    docs: DataFrame, seed: int = SEED, share: float = SHARE, epochs: int = EPOCHS, weights: tuple[float, ...] = WEIGHTS
) -> DataFrame:
    """Per row of ``docs``: doc_id, source_key, size, source_size, target, repetitions, taken."""
    sizes = settle(measured(docs, seed), "sizes")
    plan = mixture_plan(sizes, share, epochs, weights)
    return sizes.join(plan, "source_key").select(
        "doc_id", "source_key", "size", "source_size", "target", repetitions().alias("repetitions"),
        (F.col("size") * repetitions()).alias("taken"),
    )


def mixed_rows(docs: DataFrame, seed: int = SEED, share: float = SHARE, epochs: int = EPOCHS, weights=WEIGHTS) -> DataFrame:
    """``docs`` as the mix has them: every row as often as it is taken, columns unchanged."""
    sizes = settle(measured(docs, seed), "sizes")
    plan = mixture_plan(sizes, share, epochs, weights)
    own = docs.select(F.struct(*docs.columns).alias("row"), source_key().alias("source_key"), digest(seed).alias("digest"))
    taken = own.join(plan, "source_key").select("row", F.explode(F.array_repeat(F.lit(0), repetitions())).alias("again"))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


QUERY = "op9_water_filling"


def query(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "repetitions")


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 't') AS k,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS d
  FROM documents
), weighed AS (
  SELECT k, source_size, CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS w
  FROM (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY k)
), levels AS (
  SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(source_size * 2e0) OVER b, 0e0))
    / (sum(w) OVER () - coalesce(sum(w) OVER b, 0e0)) AS level
  FROM weighed
  WINDOW b AS (ORDER BY source_size * 2e0 / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), wanted AS (
  SELECT k, source_size, least(source_size * 2e0,
    coalesce(max(CASE WHEN level * w <= source_size * 2e0 THEN level END) OVER () * w, source_size * 2e0)) AS target
  FROM levels
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INTEGER) ELSE 0 END AS whole FROM wanted
), taken AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole + CASE WHEN p.target - p.whole * p.source_size > 0
    AND sum(s.size) OVER (PARTITION BY s.k ORDER BY s.d, s.size ROWS UNBOUNDED PRECEDING) - s.size / 2e0
      <= p.target - p.whole * p.source_size THEN 1 ELSE 0 END AS repetitions
  FROM sized s JOIN parts p ON s.k = p.k
)
SELECT doc_id, size, source_size, target, CAST(size * repetitions AS BIGINT) AS taken, CAST(repetitions AS INTEGER) AS repetitions
FROM taken
"""
