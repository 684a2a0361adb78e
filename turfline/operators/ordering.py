"""Ordered computations inside groups that may be very large.

A window over ``partitionBy(group)`` puts a whole group into one task. The
helpers here split each group into ordered buckets first: a bucket is a function
of the value alone, so it is the same on every evaluation. Windows then run per
(group, bucket) and the bucket totals -- bounded by the range of the values, not
by the rows -- supply the offsets. Equal values are merged by a partial aggregate
before anything is shuffled, so a heavily repeated value costs one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.session import settle

BUCKETS_PER_OCTAVE = 256


def order_bucket(value: Column, per_octave: int = BUCKETS_PER_OCTAVE) -> Column:
    """Order-preserving bucket of a number: steps of a constant ratio, sign aware.

    It needs no statistics pass and gives the same bucket on every evaluation.
    """
    size = F.floor(F.log2(F.abs(value)) * per_octave) + 1100 * per_octave
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("bigint")


def _prefix(rungs: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str]):
    """Exclusive prefix and total of ``sums`` along ``order`` inside ``keys``.

    One exchange feeds both the per-bucket totals and the per-bucket windows.
    """
    cut = rungs.withColumn("_bucket", order_bucket(F.col(order[0]).cast("double")))
    first = F.min(F.col(order[0])).alias("_first")
    bucket = cut.groupBy(*keys, "_bucket").agg(first, *[F.sum(c).alias(f"_s_{c}") for c in sums])
    along = Window.partitionBy(*keys).orderBy("_bucket")
    prior, whole = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    offsets = bucket.select(
        *keys,
        "_bucket",
        F.lead("_first").over(along).alias("_after"),
        *[F.coalesce(F.sum(f"_s_{c}").over(prior), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_s_{c}").over(whole).alias(f"{c}_total") for c in sums],
    )
    ordered = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select(
        *keys,
        "_bucket",
        *order,
        *sums,
        F.lead(order[0]).over(ordered).alias("_next"),
        *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"_l_{c}") for c in sums],
    )
    return local.join(offsets, [*keys, "_bucket"]).select(
        *keys,
        *order,
        F.coalesce("_next", "_after").alias("next_value"),
        *sums,
        *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).cast("bigint").alias(f"{c}_below") for c in sums],
        *[F.col(f"{c}_total").cast("bigint").alias(f"{c}_total") for c in sums],
    )


def row_index(
    df: DataFrame, keys: Sequence[str], score: str, ident: str, out: str, parts: int | None = None
) -> DataFrame:
    """Row number inside ``keys`` by (score, ident); ``ident`` is unique, of any type.

    The rows are dealt out by ranges of (keys, score, ident), so neither a large group nor a
    score that many rows share meets in one part; counts per part give the offsets. The
    parts are written once, as they are read twice.
    """
    order = [*keys, score, ident]
    ranged = df.repartitionByRange(*([parts] if parts else []), *order)
    cut = settle(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    counts = cut.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    skip = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    local = Window.partitionBy(*keys, "_part").orderBy(score, ident)
    numbered = cut.withColumn("_row", F.row_number().over(local)).join(skip, [*keys, "_part"])
    return numbered.withColumn(out, (F.col("_row") + F.col("_skip")).cast("bigint")).drop("_row", "_skip", "_part")


def value_ladder(
    df: DataFrame, keys: Sequence[str], value: str, counts: dict[str, Column] | None = None
) -> DataFrame:
    """Distinct values per group with, for each count, the running and total mass.

    Returns keys, value, ``<c>`` (mass at the value), ``<c>_below`` (mass strictly
    below), ``<c>_total`` and ``next_value``. Default count: ``n`` = rows.
    """
    counts = counts or {"n": F.lit(1)}
    rungs = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(*[F.sum(c).cast("bigint").alias(name) for name, c in counts.items()])
    )
    return _prefix(rungs, keys, [value], list(counts))


def midrank(ladder: DataFrame, count: str = "n") -> Column:
    """H8: 100 * (less + half of equal) / all, from ladder columns."""
    below, at, total = (F.col(f"{count}{s}") for s in ("_below", "", "_total"))
    return F.lit(100.0) * (below + at * 0.5) / total


def with_midrank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """H8 inside groups: attach each row's percentile (null value, null percentile)."""
    ladder = value_ladder(df, keys, value)
    scored = ladder.select(*keys, value, midrank(ladder).alias(out))
    return df.join(scored, [*keys, value], "left")


def with_reference_midrank(
    probes: DataFrame, reference: DataFrame, keys: Sequence[str], value: str, out: str
) -> DataFrame:
    """H8 against a fixed reference: union of both sides and one ordered pass."""
    both = reference.select(*keys, value, F.lit(1).alias("_ref")).unionByName(
        probes.select(*keys, value, F.lit(0).alias("_ref"))
    )
    ladder = value_ladder(both, keys, value, {"n": F.col("_ref")})
    scored = ladder.where(F.col("n_total") > 0).select(*keys, value, midrank(ladder).alias(out))
    return probes.join(scored, [*keys, value], "left")


def average_rank(count: str = "n") -> Column:
    """Average rank of tied values, from ladder columns."""
    return F.col(f"{count}_below") + (F.col(count) + 1) / 2.0


def quantile_columns(
    probs: dict[str, float], value: str, count: str = "n"
) -> list[Column]:
    """Linear-interpolated quantiles as aggregates over ladder rows."""
    below, at, total = (F.col(f"{count}{s}") for s in ("_below", "", "_total"))
    out = []
    for name, p in probs.items():
        spot = (total - 1) * F.lit(float(p))
        low_at, high_at = F.floor(spot), F.ceil(spot)
        low = F.max(F.when((below <= low_at) & (low_at < below + at), F.col(value)))
        high = F.max(F.when((below <= high_at) & (high_at < below + at), F.col(value)))
        part = F.max(spot - low_at)
        out.append((low + (high - low) * part).alias(name))
    return out


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles of groups of any size."""
    return value_ladder(df, keys, value).groupBy(*keys).agg(*quantile_columns(probs, value))


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, out: str = "rank"
) -> DataFrame:
    """First ``k`` rows of each group. The limit on row_number lets Spark keep only
    ``k`` rows per group and map task before the shuffle (window group limit)."""
    spot = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, spot).where(F.col(out) <= k)


def sequence_scan(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    running: dict[str, Column] | None = None,
) -> DataFrame:
    """lag / lead / inclusive running sums along a key's sequence, chunk by chunk.

    ``chunk`` must be non-decreasing along ``order`` (for example the month of a
    date), so a hot key is spread over its chunks; first rows, last rows and sums
    of the chunks -- one row each -- carry values over the borders.
    """
    lag, lead, running = lag or {}, lead or {}, running or {}
    parts = df.withColumn("_chunk", chunk)
    for name, expr in running.items():
        parts = parts.withColumn(f"_v_{name}", expr)
    edge = F.struct(*[F.col(c) for c in dict.fromkeys([*lag.values(), *lead.values()])]) if (
        lag or lead
    ) else F.struct(F.lit(1).alias("x"))
    parts = parts.withColumn("_sq_edge", edge)
    rank = F.struct(*[F.col(c) for c in order])
    chunks = parts.groupBy(*keys, "_chunk").agg(
        F.min_by("_sq_edge", rank).alias("_sq_head"),
        F.max_by("_sq_edge", rank).alias("_sq_tail"),
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in running],
    )
    along = Window.partitionBy(*keys).orderBy("_chunk")
    borders = chunks.select(
        *keys,
        "_chunk",
        F.lag("_sq_tail").over(along).alias("_sq_prev"),
        F.lead("_sq_head").over(along).alias("_sq_next"),
        *[
            F.coalesce(
                F.sum(f"_t_{name}").over(along.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias(f"_o_{name}")
            for name in running
        ],
    )
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    scanned = parts.select(
        "*",
        F.lag("_sq_edge").over(local).alias("_sq_lag"),
        F.lead("_sq_edge").over(local).alias("_sq_lead"),
        *[F.sum(f"_v_{name}").over(upto).alias(f"_r_{name}") for name in running],
    ).join(borders, [*keys, "_chunk"])
    return scanned.select(
        *df.columns,
        *[F.coalesce("_sq_lag", "_sq_prev").getField(c).alias(o) for o, c in lag.items()],
        *[F.coalesce("_sq_lead", "_sq_next").getField(c).alias(o) for o, c in lead.items()],
        *[(F.col(f"_r_{name}") + F.col(f"_o_{name}")).alias(name) for name in running],
    )
