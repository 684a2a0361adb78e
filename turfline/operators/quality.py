"""Data quality and audit operators.

Each check returns violation rows or one row of counters per rule; nothing stops
the job, so a report over many tables is a union of small aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline.operators.ordering import sequence_scan


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each rule, all rules in one pass. A null verdict passes."""
    counted = df.agg(*[F.count_if(cond).alias(name) for name, cond in rules.items()])
    return counted.unpivot([], list(rules), "rule", "violations")


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null or repeated keys with their row counts."""
    null_key = F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(
        keys[0]
    ).isNull()
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    problem = F.when(null_key, "null_key").otherwise("duplicate_key")
    return grouped.where(null_key | (F.col("rows") > 1)).withColumn("problem", problem)


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Distinct non-null references without a parent, with their row counts.

    References are merged before the anti join, so a hot reference is one row.
    """
    used = (
        child.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("reference"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return used.join(parent.select(F.col(key).alias("reference")), "reference", "left_anti")


def foreign_key_report(checks: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """One row per declared reference."""
    parts = [
        orphans(child, column, parent, key).agg(
            F.lit(name).alias("reference_name"),
            F.count(F.lit(1)).alias("missing_keys"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        )
        for name, child, column, parent, key in checks
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def outside_pair(
    rows: DataFrame, pairs: DataFrame, unit: str, member: str, first: str, second: str
) -> DataFrame:
    """C4: rows whose member is neither of the unit's two sides."""
    seen = rows.groupBy(unit, member).agg(F.count(F.lit(1)).alias("rows"))
    return (
        seen.where(F.col(member).isNotNull())
        .join(pairs.select(unit, first, second), unit)
        .where((F.col(member) != F.col(first)) & (F.col(member) != F.col(second)))
        .select(unit, member, "rows")
    )


def identical_sides(pairs: DataFrame, unit: str, first: str, second: str) -> DataFrame:
    """C4: units playing themselves."""
    return pairs.where(F.col(first) == F.col(second)).select(unit, first)


def unexpected_cardinality(
    units: DataFrame, rows: DataFrame, keys: Sequence[str], flag: Column, expected: int
) -> DataFrame:
    """Units whose flagged rows differ from the expectation; none counts as 0."""
    flagged = rows.groupBy(*keys).agg(F.count_if(flag).alias("found"))
    joined = units.join(flagged, list(keys), "left")
    found = F.coalesce("found", F.lit(0))
    return joined.select(*keys, found.alias("found")).where(F.col("found") != expected)


def coordinate_rules(x: str = "x", y: str = "y") -> dict[str, Column]:
    """Pair completeness, finiteness, envelope and off-pitch counters."""
    cx, cy = F.col(x), F.col(y)
    both = cx.isNotNull() & cy.isNotNull()
    finite = ~F.isnan(cx) & ~F.isnan(cy) & (F.abs(cx) < float("inf")) & (F.abs(cy) < float("inf"))
    return {
        "half_pair": cx.isNull() != cy.isNull(),
        "not_finite": both & ~finite,
        "outside_envelope": both & ~(cx.between(-10, 115) & cy.between(-10, 78)),
        "off_pitch_retained": both & ~(cx.between(0, 105) & cy.between(0, 68)),
    }


def order_violations(
    rows: DataFrame, unit: str, index: str, period: str, clock: str, chunk: Column
) -> DataFrame:
    """Period steps backwards (error) and clock inversions (warning) per unit."""
    scanned = sequence_scan(
        rows.select(unit, index, period, clock),
        [unit],
        chunk,
        [index],
        lag={"_p": period, "_c": clock},
    )
    back = F.count_if(F.col(period) < F.col("_p"))
    inverted = F.count_if((F.col(period) == F.col("_p")) & (F.col(clock) < F.col("_c")))
    return scanned.groupBy(unit).agg(
        back.alias("period_errors"), inverted.alias("clock_inversions")
    )


def above_ceiling(rows: DataFrame, unit: str, flag: Column, ceiling: int) -> DataFrame:
    """Units with more flagged rows than the ceiling."""
    counted = rows.where(flag).groupBy(unit).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > ceiling)


def null_profile(df: DataFrame, table: str) -> DataFrame:
    """Nulls of every column, one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counted.unpivot([], df.columns, "column_name", "nulls").select(
        F.lit(table).alias("table_name"), "column_name", "nulls"
    )


def content_conflicts(df: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """C11: keys seen with different content. Equal copies merge map-side."""
    variants = df.select(*keys, *content).distinct()
    grouped = variants.groupBy(*keys).agg(F.count(F.lit(1)).alias("variants"))
    return grouped.where(F.col("variants") > 1)


def earliest_sighting(
    df: DataFrame, keys: Sequence[str], attributes: Sequence[str], seen: str
) -> DataFrame:
    """One row per dimension key from its earliest sighting, conflicts flagged.

    ``min_by`` and the per-attribute extremes are combinable, so repeated
    sightings of one key shrink before the shuffle.
    """
    order = F.struct(F.col(seen), *[F.col(a) for a in attributes])
    first = F.min_by(F.struct(*attributes), order)
    varied = [~F.min(a).eqNullSafe(F.max(a)) | ((F.count(a) > 0) & (F.count(a) < F.count(F.lit(1)))) for a in attributes]
    return df.groupBy(*keys).agg(
        first.alias("_first"),
        F.min(seen).alias(seen),
        (F.greatest(*varied) if len(varied) > 1 else varied[0]).alias("conflict"),
    ).select(*keys, "_first.*", seen, "conflict")


def scope_counters(
    rows: DataFrame, scope: Sequence[str], counters: dict[str, Column]
) -> DataFrame:
    """Counters per scope from one conditional aggregate."""
    return rows.groupBy(*scope).agg(*[F.count_if(c).alias(n) for n, c in counters.items()])


def schedule_completeness(
    fixtures: DataFrame, scope: Sequence[str], home: str, away: str, near: float = 0.9
) -> DataFrame:
    """Fixtures against a double round robin n(n-1), with a status."""
    pairs = fixtures.groupBy(*scope, home, away).agg(F.count(F.lit(1)).alias("rows"))
    sides = (
        pairs.select(*scope, F.explode(F.array(home, away)).alias("team"))
        .distinct()
        .groupBy(*scope)
        .agg(F.count(F.lit(1)).alias("teams"))
    )
    played = pairs.where(F.col(home) != F.col(away)).groupBy(*scope).agg(
        F.count(F.lit(1)).alias("unique_pairs"), F.sum("rows").alias("matches")
    )
    expected = F.col("teams") * (F.col("teams") - 1)
    share = F.col("unique_pairs") / F.col("expected")
    status = (
        F.when((F.col("unique_pairs") == F.col("expected")) & (F.col("matches") == F.col("expected")), "complete")
        .when(share >= near, "near")
        .when(share >= 0.5, "partial")
        .otherwise("sample")
    )
    return (
        sides.join(played, list(scope))
        .withColumn("expected", expected)
        .withColumn("status", status)
    )


def roster_coverage(rows: DataFrame, scope: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """Coverage ratios and distinct players per season."""
    per_player = rows.groupBy(*scope, "player_id").agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(n) for n, c in flags.items()]
    )
    return per_player.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("players"),
        F.sum("_n").alias("rows"),
        *[(F.sum(n) / F.sum("_n")).alias(n) for n in flags],
    )


def season_catalogue(matches: DataFrame, scope: Sequence[str], home: str, away: str, date: str) -> DataFrame:
    """C17: matches, teams over both sides, first and last date."""
    sides = (
        matches.select(*scope, F.explode(F.array(home, away)).alias("team"))
        .distinct()
        .groupBy(*scope)
        .agg(F.count(F.lit(1)).alias("teams"))
    )
    span = matches.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("matches"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )
    return span.join(sides, list(scope))


def publication_gate(summary: DataFrame, ok: Column, message: str) -> DataFrame:
    """Pass rows through, raise on the executors when the gate fails."""
    return summary.where(
        F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).isNotNull())
    )


def identity_audit(rows: DataFrame) -> DataFrame:
    """C20: distinct identities per provider after merging their rows."""
    merged = rows.groupBy("provider", "player_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("reasons") > 0).alias("bad")
    )
    return merged.groupBy("provider").agg(
        F.count(F.lit(1)).alias("identities"),
        F.sum("n").alias("rows"),
        F.count_if(F.col("bad") > 0).alias("with_exclusions"),
    )
