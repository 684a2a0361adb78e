"""Period ends and elapsed-time offsets per match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def period_ends(events: DataFrame, end_marker=None) -> DataFrame:
    """Length of each period (latest end marker) and seconds elapsed before it.

    The window runs over the at most four periods of one match, after aggregation.
    """
    marked = events.where(F.col("period") < 5)
    if end_marker is not None:
        marked = marked.where(end_marker)
    length = marked.groupBy("match_id", "period").agg(F.max("clock").alias("length"))
    before = Window.partitionBy("match_id").orderBy("period").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return length.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0.0)))
