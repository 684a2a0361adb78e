"""Roll-ups from player-match observations to season profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.functions.constants import MINIMUM_ROLE_SIZE
from turfline.functions.measures import (
    all_or_null_sum,
    guarded_ratio,
    per90,
    reason_list,
    role_share_entropy,
)
from turfline.functions.text import role_family
from turfline.operators.ordering import quantile_columns, value_ladder, with_midrank


# -- marts -----------------------------------------------------------------------


def player_match_mart(
    events: DataFrame, lineups: DataFrame, players: DataFrame, teams: DataFrame, matches: DataFrame,
    native: str = "statsbomb",
) -> DataFrame:
    """per line-up row counts; unavailable (not zero) outside the native provider."""
    kind = F.col("event_type")
    counts = (
        events.where(F.col("period") < 5)
        .groupBy("match_id", "player_id")
        .agg(
            F.count_if(kind == "Shot").alias("n_shots"),
            F.count_if(kind == "Pass").alias("n_passes"),
            F.count_if((kind == "Pass") & (F.col("outcome") == "Complete")).alias("n_completed"),
            F.count_if((kind == "Shot") & (F.col("outcome") == "Goal")).alias("n_goals"),
            F.sum("xg").alias("n_xg"),
            F.count_if((kind == "Shot") & F.col("xg").isNull()).alias("n_xg_missing"),
        )
    )
    own = F.col("provider") == native
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        lineups.join(players, "player_id")
        .join(teams, "team_id")
        .join(matches, "match_id")
        .join(counts, ["match_id", "player_id"], "left")
        .select(
            "id",
            "provider",
            "match_id",
            "player_id",
            "player_name",
            "team_id",
            "team_name",
            "season_id",
            "competition_id",
            "observed_on",
            "starter",
            "position",
            "minutes",
            "minutes_method",
            F.when(own, zero("n_shots")).alias("shots"),
            F.when(own, zero("n_passes")).alias("passes"),
            F.when(own, zero("n_completed")).alias("completed_passes"),
            F.when(own, zero("n_goals")).alias("goals"),
            F.when(own & (zero("n_xg_missing") == 0), zero("n_xg").cast("double")).alias("xg"),
            F.when(own & (F.col("minutes") >= 30), zero("n_shots") / F.col("minutes") * 90).alias(
                "shots_per90"
            ),
            F.when(F.col("n_passes") > 0, F.col("n_completed") / F.col("n_passes")).alias(
                "pass_completion"
            ),
        )
    )


def player_season_mart(player_match: DataFrame) -> DataFrame:
    """season rows; minutes, xg and rates only when every match has them."""
    minutes = all_or_null_sum("minutes")
    return player_match.groupBy(
        "provider", "season_id", "competition_id", "player_id", "player_name"
    ).agg(
        F.count(F.lit(1)).alias("roster_matches"),
        F.count_if(F.col("minutes") > 0).alias("appearances"),
        minutes.alias("minutes"),
        F.sum(F.col("starter").cast("int")).alias("starts"),
        F.sum("shots").alias("shots"),
        F.sum("passes").alias("passes"),
        F.sum("goals").alias("goals"),
        all_or_null_sum("xg").alias("xg"),
        F.when(minutes >= 30, F.sum("shots") / minutes * 90).alias("shots_per90"),
    )


def team_season_mart(player_match: DataFrame) -> DataFrame:
    """team sums; matches are merged before they are counted."""
    keys = ["provider", "season_id", "competition_id", "team_id", "team_name"]
    per_match = player_match.groupBy(*keys, "match_id").agg(
        *[F.sum(c).alias(c) for c in ("shots", "passes", "goals")]
    )
    return per_match.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matches"),
        F.sum("shots").alias("shots"),
        F.sum("passes").alias("passes"),
        F.sum("goals").alias("player_goals_excluding_own_goals"),
    )


# -- season profiles ---------------------------------------------------------------


def usable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reliable") & (F.col("minutes") > 0))


def role_summary(role_minutes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """roles of each key from (keys, role, role_minutes, total_minutes) rows.

    Sorted arrays replace a window: a key holds at most one entry per role.
    """
    known = role_minutes.where((F.col("role") != "unknown") & (F.col("role_minutes") > 0))
    merged = known.groupBy(*keys, "role").agg(
        F.sum("role_minutes").alias("m"), F.max("total_minutes").alias("total")
    )
    share = F.col("m") / F.col("total")
    listed = merged.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("m")).alias("o"), "role", share.alias("share")))
        ).alias("ranked")
    )
    first = F.col("ranked").getItem(0)
    shares = F.map_from_entries(
        F.transform("ranked", lambda s: F.struct(s["role"], s["share"]))
    )
    total_share = F.aggregate("ranked", F.lit(0.0), lambda a, s: a + s["share"])
    entropy = F.aggregate("ranked", F.lit(0.0), lambda a, s: a + role_share_entropy(s["share"]))
    confident = (total_share >= 0.6) & (first["share"] >= 0.4)
    return listed.select(
        *keys,
        F.when(confident, first["role"]).alias("primary_role"),
        F.try_element_at("ranked", F.lit(2))["role"].alias("secondary_role"),
        shares.alias("role_shares"),
        total_share.alias("known_role_share"),
        (first["share"] < 0.7).alias("multi_role"),
        entropy.alias("role_entropy"),
    )


def observation_roles(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Role minutes of observations: a ``role_minutes`` map or a single ``role``."""
    total = rows.groupBy(*keys).agg(F.sum("minutes").alias("total_minutes"))
    if "role_minutes" in rows.columns:
        parts = rows.select(*keys, F.explode("role_minutes").alias("role", "role_minutes"))
    else:
        parts = rows.select(*keys, "role", F.col("minutes").alias("role_minutes"))
    merged = parts.groupBy(*keys, "role").agg(F.sum("role_minutes").alias("role_minutes"))
    return merged.join(total, list(keys))


def season_totals(
    rows: DataFrame, keys: Sequence[str], counts: Sequence[str], carry: Sequence[str] = ()
) -> DataFrame:
    """F4 first half: exposure and all-or-null totals over reliable rows."""
    return usable(rows).groupBy(*keys).agg(
        F.sum("minutes").alias("minutes"),
        F.count(F.lit(1)).alias("appearances"),
        *[F.min(c).alias(c) for c in carry],
        *[all_or_null_sum(c).alias(c) for c in counts],
    )


def _totals_by_role(rows: DataFrame, keys: Sequence[str], counts: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """``season_totals`` and the primary role in one pass: sums per role carry both. A key with a null has no role."""
    parts = usable(rows).groupBy(*keys, "role").agg(
        F.sum("minutes").alias("_m"),
        F.count(F.lit(1)).alias("_n"),
        *[F.min(c).alias(c) for c in carry],
        *[F.sum(c).alias(c) for c in counts],
        *[F.count(c).alias(f"_n_{c}") for c in counts],
    )
    known = F.col("role") != "unknown"
    whole = parts.groupBy(*keys).agg(
        F.sum("_m").alias("minutes"),
        F.sum("_n").alias("appearances"),
        *[F.min(c).alias(c) for c in carry],
        *[F.when(F.sum(f"_n_{c}") == F.sum("_n"), F.sum(c)).alias(c) for c in counts],
        F.sum(F.when(known, F.col("_m"))).alias("_known"),
        F.min(F.when(known, F.struct((-F.col("_m")).alias("o"), "role"))).alias("_first"),
    )
    confident = (F.col("_known") / F.col("minutes") >= 0.6) & (-F.col("_first")["o"] / F.col("minutes") >= 0.4)
    for key in keys:
        confident &= F.col(key).isNotNull()
    return whole.withColumn("primary_role", F.when(confident, F.col("_first")["role"])).drop("_known", "_first")


def season_profiles(
    rows: DataFrame, keys: Sequence[str], counts: Sequence[str], carry: Sequence[str] = ()
) -> DataFrame:
    """rates per 90 of all-or-null totals with the confident primary role."""
    if "role_minutes" in rows.columns:
        totals = season_totals(rows, keys, counts, carry)
        roles = role_summary(observation_roles(usable(rows), keys), keys).select(*keys, "primary_role")
        both = totals.join(roles, list(keys), "left")
    else:
        both = _totals_by_role(rows, keys, counts, carry)
    return both.select(
        *keys,
        "minutes",
        *carry,
        "appearances",
        "primary_role",
        *[per90(c, "minutes").alias(f"{c}_per90") for c in counts],
    )


def derived_values(totals: DataFrame) -> DataFrame:
    """output and context ratios from season totals."""
    return totals.withColumns(
        {
            "npxg_per90": per90("npxg", "minutes"),
            "xa_per90": per90("xa", "minutes"),
            "xg_per_shot": guarded_ratio("npxg", "shots"),
            "pass_completion": guarded_ratio("completed_passes", "passes"),
            "pressures_per100_opponent": guarded_ratio(
                "pressures", "opponent_possessions", 100
            ),
            "interceptions_per100_opponent": guarded_ratio(
                "interceptions", "opponent_possessions", 100
            ),
            "progressive_passes_per100_team": guarded_ratio(
                "progressive_passes", "own_possessions", 100
            ),
            "team_pass_share": guarded_ratio("passes", "team_passes"),
        }
    )


# -- eligibility -------------------------------------------------------------------


def eligibility_reasons(threshold: Column, core: Sequence[str]) -> Column:
    """F8: why a profile cannot be compared at a threshold."""
    missing = F.greatest(*[F.col(c).isNull() for c in core]) if len(core) > 1 else F.col(
        core[0]
    ).isNull()
    return reason_list(
        (F.col("minutes") < threshold, "below_minutes"),
        (F.coalesce(F.col("primary_role"), F.lit("")) == "", "uncertain_role"),
        (F.col("primary_role") == "GK", "goalkeeper_excluded"),
        (missing, "missing_core_features"),
    )


def comparison_cohort(
    profiles: DataFrame, keys: Sequence[str], threshold: float, core: Sequence[str],
    minimum: int = MINIMUM_ROLE_SIZE,
) -> DataFrame:
    """F9 selection: eligible profiles of roles with at least ``minimum`` of them.

    Role sizes are a small aggregate joined back, not a window over whole roles.
    """
    eligible = profiles.where(F.size(eligibility_reasons(F.lit(threshold), core)) == 0)
    sizes = eligible.groupBy("primary_role").agg(F.count(F.lit(1)).alias("role_size"))
    return eligible.join(sizes.where(F.col("role_size") >= minimum), "primary_role")


def threshold_sweep(
    profiles: DataFrame, core: Sequence[str], thresholds: Sequence[float],
    minimum: int = MINIMUM_ROLE_SIZE,
) -> tuple[DataFrame, DataFrame]:
    """(role sizes, exclusion histogram) per threshold; the profile table is read once."""
    at = profiles.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    judged = at.withColumn("reasons", eligibility_reasons(F.col("threshold"), core))
    sizes = (
        judged.where(F.size("reasons") == 0)
        .groupBy("threshold", "primary_role")
        .agg(F.count(F.lit(1)).alias("players"))
        .withColumn("sparse_role", F.col("players") < minimum)
    )
    exclusions = reason_histogram(judged, ["threshold"])
    return sizes, exclusions


def reason_histogram(rows: DataFrame, keys: Sequence[str], reasons: str = "reasons") -> DataFrame:
    """Rows per reason."""
    return (
        rows.select(*keys, F.explode(reasons).alias("reason"))
        .groupBy(*keys, "reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def threshold_counts(profiles: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """profiles at or above each threshold."""
    return profiles.agg(
        *[F.count_if(F.col("minutes") >= t).alias(f"at_{int(t)}") for t in thresholds]
    )


def cohort_report(
    profiles: DataFrame, values: Sequence[str], features: Sequence[str], probs: dict[str, float]
) -> tuple[DataFrame, DataFrame]:
    """exact quantiles of measures, and availability of features."""
    long = profiles.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value"))
                    for v in values
                ]
            )
        ).alias("m")
    ).select("m.measure", "m.value")
    quantiles = value_ladder(long, ["measure"], "value").groupBy("measure").agg(
        *quantile_columns(probs, "value")
    )
    return quantiles, availability(profiles, features)


def availability(profiles: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with a value, per feature, from one pass over the table."""
    counts = profiles.agg(F.count(F.lit(1)).alias("n"), *[F.count(f).alias(f) for f in features])
    return counts.unpivot(["n"], list(features), "feature", "available")


# -- scoped profiles (F11-F14) -------------------------------------------------------


def common_values(minutes: Column) -> dict[str, Column]:
    """shared rates; withheld when outcomes or geometry are missing."""
    no_outcome, no_place = F.col("c_outcome_missing") > 0, F.col("c_geometry_missing") > 0
    rate = lambda c: F.round(F.col(c) * 90 / minutes, 6)
    ok = minutes > 0
    completion = F.round(F.col("c_completed") / F.col("c_passes"), 6)
    return {
        "shots_per90": F.when(ok, rate("c_shots")),
        "passes_per90": F.when(ok, rate("c_passes")),
        "completion": F.when(ok & (F.col("c_passes") > 0) & ~no_outcome, completion),
        "long_per90": F.when(ok & ~no_place, rate("c_long")),
        "progressive_per90": F.when(ok & ~no_place & ~no_outcome, rate("c_progressive")),
        "final_third_per90": F.when(ok & ~no_place & ~no_outcome, rate("c_final_third")),
        "box_per90": F.when(ok & ~no_place & ~no_outcome, rate("c_box")),
    }


def native_values(counts: Sequence[str], minutes: Column) -> dict[str, Column]:
    """native rates and the open-play completion."""
    completion = F.when(
        (minutes > 0)
        & (F.col("open_passes") > 0)
        & (F.col("open_outcome_missing") == 0)
        & F.col("open_completed").isNotNull(),
        F.round(F.col("open_completed") / F.col("open_passes"), 6),
    )
    rates = {
        f"{c}_per90": F.when(minutes > 0, F.round(F.col(c) * 90 / minutes, 6)) for c in counts
    }
    return {"open_completion": completion, **rates}


def scoped_profiles(
    rows: DataFrame, common: Sequence[str], native: Sequence[str], required: Sequence[str],
    by_role_minutes: bool = False,
) -> DataFrame:
    """one profile per (scope, player); unreliable rows withhold it with reasons.

    ``by_role_minutes`` picks the family from minutes per role (confidence gate of
    F6); otherwise the one family all rows agree on.
    """
    keys = ["scope", "player_id"]
    reliable_minutes = F.coalesce(F.sum(F.when(F.col("reliable"), F.col("minutes"))), F.lit(0.0))
    base = rows.groupBy(*keys).agg(
        F.min("provider").alias("provider"),
        reliable_minutes.alias("minutes"),
        F.count(F.lit(1)).alias("appearances"),
        (F.count_if(~F.col("reliable")) > 0).alias("_withheld"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.array_sort(F.collect_set("team_id")).alias("teams"),
        F.array_sort(F.collect_set("role_family")).alias("_families"),
        F.array_distinct(F.flatten(F.collect_set("reasons"))).alias("_reasons"),
        *[F.sum(c).alias(c) for c in common],
        *[all_or_null_sum(c).alias(c) for c in native],
    )
    if by_role_minutes:
        fine = rows.select(
            *keys, F.explode("role_minutes").alias("role", "role_minutes"), "elapsed_minutes"
        )
        total = rows.groupBy(*keys).agg(
            F.sum(F.coalesce("elapsed_minutes", F.lit(0.0))).alias("total_minutes")
        )
        broad = fine.select(
            *keys, F.coalesce(role_family("role"), F.lit("unknown")).alias("role"), "role_minutes"
        ).join(total, keys)
        picked = role_summary(broad, keys).select(
            *keys, F.col("primary_role").alias("role_family")
        )
        base = base.join(picked, keys, "left")
    else:
        base = base.withColumn(
            "role_family", F.when(F.size("_families") == 1, F.col("_families").getItem(0))
        )
    valued = base.withColumns(common_values(F.col("minutes")))
    reasons = F.array_sort(
        F.array_distinct(
            F.concat(
                F.col("_reasons"),
                reason_list(
                    (F.col("_withheld"), "unresolved_participation_conflict"),
                    (F.col("role_family").isNull(), "unknown_or_ambiguous_role"),
                    (F.col("minutes") <= 0, "no_reliable_minutes"),
                ),
            )
        )
    )
    unavailable = reason_list(*[(F.col(v).isNull(), v) for v in required])
    ready = (
        (F.size("exclusion_reasons") == 0)
        & ~F.col("role_family").eqNullSafe("GK")
        & (F.size("common_unavailable") == 0)
    )
    return (
        valued.withColumn("exclusion_reasons", reasons)
        .withColumn("common_unavailable", unavailable)
        .withColumn("common_ready", ready)
        .drop("_withheld", "_families", "_reasons")
    )


def feature_profiles(rows: DataFrame, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """summed native features with the union of unavailable ones; withheld as a
    whole when any row is unreliable. Minutes by team come as a map."""
    per_team = rows.groupBy(*keys, "team_id").agg(
        F.sum(F.coalesce("minutes", F.lit(0.0))).alias("team_minutes"),
        F.min("reliable").alias("reliable"),
        F.count(F.lit(1)).alias("appearances"),
        F.array_distinct(F.flatten(F.collect_set("unavailable"))).alias("unavailable"),
        *[F.sum(c).alias(c) for c in counts],
    )
    whole = per_team.groupBy(*keys).agg(
        F.min("reliable").alias("reliable"),
        F.sum("team_minutes").alias("minutes"),
        F.sum("appearances").alias("appearances"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("team_id", "team_minutes")))
        ).alias("minutes_by_team"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("unavailable")))).alias(
            "unavailable"
        ),
        *[F.sum(c).alias(c) for c in counts],
    )

    def value(name: str) -> Column:
        shown = F.col("reliable") & (F.col("minutes") > 0) & ~F.array_contains("unavailable", name)
        return F.when(shown, F.round(F.col(name) * 90 / F.col("minutes"), 6))

    completion = F.when(
        F.col("reliable")
        & (F.col("minutes") > 0)
        & (F.col("passes") > 0)
        & ~F.array_contains("unavailable", "pass_completion"),
        F.round(100 * F.col("completed_passes") / F.col("passes"), 6),
    )
    return whole.select(
        *keys,
        "reliable",
        "minutes",
        "appearances",
        "minutes_by_team",
        "unavailable",
        *[value(c).alias(c) for c in counts],
        completion.alias("pass_completion"),
    )


# -- club context ---------------------------------------------------------------------


def team_season_context(
    rows: DataFrame, scope: Sequence[str], counts: Sequence[str]
) -> DataFrame:
    """team rates with their midrank percentile inside the season."""
    keys = [*scope, "team_id"]
    totals = season_totals(rows.withColumn("reliable", F.lit(True)), keys, counts)
    present = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matches"), *[F.count(c).alias(f"_a_{c}") for c in counts]
    )
    long = totals.join(present, keys).select(
        *keys,
        "matches",
        "minutes",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(f"{c}_per90").alias("feature"),
                        per90(c, "minutes").alias("value"),
                        F.col(f"_a_{c}").alias("available_matches"),
                    )
                    for c in counts
                ]
            )
        ).alias("f"),
    ).select(*keys, "matches", "minutes", "f.*")
    return with_midrank(long, [*scope, "feature"], "value", "percentile")


def roster_depth(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F18 part one: depth, minutes, top share and HHI per club and role."""
    total = F.sum("minutes")
    return members.groupBy(*keys).agg(
        F.count_if(F.col("minutes") > 0).alias("roster_depth"),
        F.count_if(F.col("profile_eligible")).alias("profile_depth"),
        total.alias("reliable_minutes"),
        F.when(total > 0, F.max("minutes") / total).alias("top_player_minutes_share"),
        F.when(total > 0, F.sum(F.col("minutes") * F.col("minutes")) / (total * total)).alias(
            "minutes_hhi"
        ),
    )


def roster_spread(
    percentiles: DataFrame, keys: Sequence[str], value: str = "percentile"
) -> DataFrame:
    """F18/F19 part two: quantiles of member percentiles per club, role and feature."""
    probs = {"median": 0.5, "p25": 0.25, "p75": 0.75, "minimum": 0.0, "maximum": 1.0}
    return value_ladder(percentiles, keys, value).groupBy(*keys).agg(
        F.sum("n").alias("members"), *quantile_columns(probs, value)
    )


def club_role_distribution(
    profiles: DataFrame, keys: Sequence[str], features: Sequence[str],
    minimum_minutes: float = 90, minimum_members: int = 2,
) -> DataFrame:
    """median and quartiles per club-role feature, with the percentile of the
    median among all members of the role."""
    long = melt(profiles.where(F.col("minutes") >= minimum_minutes), [*keys], features)
    spread = (
        value_ladder(long, [*keys, "feature"], "value")
        .groupBy(*keys, "feature")
        .agg(
            F.sum("n").alias("members"),
            *quantile_columns({"median": 0.5, "q25": 0.25, "q75": 0.75}, "value"),
        )
        .where(F.col("members") >= minimum_members)
    )
    return spread


def melt(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Wide feature columns to (keys, feature, value) rows."""
    return df.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
                    for f in features
                ]
            )
        ).alias("m"),
    ).select(*keys, "m.feature", "m.value")


# -- catalogue -------------------------------------------------------------------------


def catalogue_counts(rows: DataFrame) -> DataFrame:
    """distinct identities, scopes and matches; merged keys are counted, so no
    distinct aggregate multiplies the input."""
    players = rows.groupBy("provider", "player_id").agg(F.sum("minutes").alias("m"))
    scopes = rows.groupBy("scope").agg(F.count(F.lit(1)).alias("rows"))
    matches = rows.select("provider", "match_id").distinct()
    return (
        players.agg(F.count(F.lit(1)).alias("players"), F.sum("m").alias("minutes"))
        .join(scopes.agg(F.count(F.lit(1)).alias("scopes"), F.sum("rows").alias("rows")))
        .join(matches.agg(F.count(F.lit(1)).alias("matches")))
    )


def scope_summary(profiles: DataFrame, scope: Sequence[str], minimum: float) -> DataFrame:
    """profiles, searchable ones and their exclusion count per scope."""
    return profiles.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("profiles"),
        F.count_if(F.col("minutes") >= minimum).alias("searchable"),
        F.count_if(F.size("exclusion_reasons") > 0).alias("excluded"),
        F.count_if(F.col("common_ready")).alias("common_ready"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )


def searchable_index(profiles: DataFrame, minimum: float) -> DataFrame:
    """one search row per profile with capability flags."""
    return profiles.where(F.col("minutes") >= minimum).select(
        "scope",
        "player_id",
        "provider",
        "role_family",
        "minutes",
        F.col("common_ready").alias("can_compare"),
        (F.size("exclusion_reasons") == 0).alias("reliable"),
        (F.size("teams") > 1).alias("multi_club"),
    )


def merge_records(rows: DataFrame, keys: Sequence[str], record: Sequence[str]) -> DataFrame:
    """one row per player-season with a team map and the raw records."""
    return rows.groupBy(*keys).agg(
        F.map_from_entries(
            F.array_sort(F.array_distinct(F.collect_list(F.struct("team_id", "team_name"))))
        ).alias("teams"),
        F.array_sort(F.collect_list(F.struct(*record))).alias("records"),
    )


def window_roles(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest role per key without the confidence gate (diagnostics)."""
    place = Window.partitionBy(*keys).orderBy(F.desc("m"), "role")
    merged = rows.groupBy(*keys, "role").agg(F.sum("minutes").alias("m"))
    return merged.withColumn("place", F.row_number().over(place)).where(F.col("place") == 1)
