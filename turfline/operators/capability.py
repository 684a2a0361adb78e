"""Threshold grids by scope and the capability table made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.functions.measures import reason_list
from turfline.operators import evaluation as E
from turfline.operators import similarity as S
from turfline.session import settle


def complete(core: Sequence[str]):
    """No core feature is missing."""
    return ~F.greatest(*[F.col(c).isNull() for c in core])


def eligible_profiles(full: DataFrame, thresholds: Sequence[float], core: Sequence[str]) -> DataFrame:
    """One row per profile and threshold that its minutes reach, where role and features are known."""
    known = full.where(F.col("primary_role").isNotNull() & (F.col("primary_role") != "GK") & complete(core))
    steps = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    return known.withColumn("threshold", F.explode(F.filter(steps, lambda t: F.col("minutes") >= t)))


def eligible_pairs(
    eligible: DataFrame, halves: DataFrame, scope: Sequence[str], ident: str, core: Sequence[str]
) -> DataFrame:
    """Half profiles of every eligible profile both halves of which reach half its threshold.

    halves: ident, half (0, 1), minutes and core features. The role is that of the whole profile."""
    fit = halves.where(complete(core)).groupBy(ident).agg(F.min("minutes").alias("_low"), F.count(F.lit(1)).alias("_sides"))
    paired = eligible.join(fit.where(F.col("_sides") == 2), ident).where(F.col("_low") >= F.col("threshold") / 2)
    kept = paired.select(*scope, "threshold", "primary_role", ident)
    return kept.join(halves.select(ident, "half", *core), ident)


def threshold_grid(
    eligible: DataFrame, pairs: DataFrame, scope: Sequence[str], ident: str, families: dict[str, str],
    draws: int = 50, minimum_pairs: int = 20,
) -> DataFrame:
    """Half-to-half retrieval and gate of every (scope, threshold, role).

    The scaler is fitted on half 0 of the group alone and only its members compete. Positions
    are averaged over ties; the interval of the mean reciprocal rank is a bootstrap over players.
    Groups with profiles but fewer than two pairs have no metrics and the reason
    ``insufficient_pairs``."""
    group, core = [*scope, "threshold", "primary_role"], list(families)
    first, second = (settle(pairs.where(F.col("half") == h).drop("half"), f"half{h}") for h in (0, 1))
    scaler = settle(S.fit_scaling(first, group, families, "standard"), "scaler")
    vectors = lambda d, n: settle(S.standardise(d, scaler, group, core).select(*group, ident, "vec"), n)
    ranks = S.counterpart_ranks(vectors(first, "first"), vectors(second, "second"), group, ident)
    ranks = settle(E.tie_aware(ranks), "ranks")
    found = ranks.groupBy(*group).agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg("tie_recall5").alias("recall5"),
        F.avg("tie_recall10").alias("recall10"),
        F.avg("rr").alias("mrr"),
    )
    picked = E.resample(ranks.select(*group, ident, "earlier", "rr"), group, "earlier", ident, draws, "grid")
    means = picked.groupBy(*group, "draw").agg((F.sum(F.col("rr") * F.col("times")) / F.sum("times")).alias("m"))
    bounds = means.groupBy(*group).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("b"))
    stable = E.feature_stability(first, second, group, ident, core)
    median = stable.groupBy(*group).agg(
        F.percentile("spearman", F.lit(0.5)).alias("median_spearman"), F.count("spearman").alias("nonconstant_features")
    )
    sizes = eligible.groupBy(*group).agg(F.count(F.lit(1)).alias("eligible_profiles"))
    joined = (
        sizes.join(found, group, "left")
        .join(E.random_expectation(ranks, group).select(*group, "random_recall5", "random_recall10", "random_mrr"), group, "left")
        .join(bounds.select(*group, F.col("b")[0].alias("mrr_low"), F.col("b")[1].alias("mrr_high")), group, "left")
        .join(median, group, "left")
        .withColumn("queries", F.coalesce("queries", F.lit(0)).cast("long"))
    )
    judged = E.role_gate(joined, group, minimum_pairs)
    few = F.col("queries") < 2
    blank = ["recall5", "recall10", "mrr", "random_recall5", "random_recall10", "random_mrr", "mrr_low", "mrr_high", "median_spearman", "nonconstant_features"]
    return judged.withColumns(
        {
            **{c: F.when(~few, F.col(c)) for c in blank},
            "reasons": F.when(few, F.array(F.lit("insufficient_pairs"))).otherwise(F.col("reasons")),
            "passed": ~few & F.col("passed"),
        }
    )


def provider_summary(grid: DataFrame, provider: str, minimum_pairs: int = 20) -> DataFrame:
    """Per provider and threshold the scopes and roles with enough pairs, their pairs and the
    mean reciprocal rank and recall weighted by pairs."""
    enough = grid.where(F.col("queries") >= minimum_pairs)
    weighted = lambda c: (F.sum(F.col(c) * F.col("queries")) / F.sum("queries")).alias(c)
    return enough.groupBy(provider, "threshold").agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum("queries").alias("pairs"),
        *[weighted(c) for c in ("recall5", "recall10", "mrr", "random_recall5", "random_mrr")],
        F.count_if("passed").alias("passing"),
    )


def club_roles(
    eligible: DataFrame, chosen: DataFrame, club_minutes: DataFrame, scope: Sequence[str], ident: str,
    minimum_minutes: float = 90.0, minimum_members: int = 2,
) -> DataFrame:
    """Members of every club and enabled role at the chosen threshold, and whether they suffice.

    club_minutes: scope, ident, team_id, minutes. A player counts for every club with enough minutes."""
    enabled = chosen.select(*scope, "threshold", F.explode("roles").alias("primary_role"))
    members = eligible.join(enabled, [*scope, "threshold", "primary_role"]).select(*scope, "primary_role", ident)
    present = club_minutes.where(F.col("minutes") >= minimum_minutes).select(*scope, ident, "team_id")
    counted = members.join(present, [*scope, ident]).groupBy(*scope, "team_id", "primary_role").agg(
        F.count(F.lit(1)).alias("members")
    )
    return counted.withColumn("target", F.col("members") >= minimum_members)


def capability_table(
    scopes: DataFrame, grid: DataFrame, chosen: DataFrame, clubs: DataFrame, scope: Sequence[str],
    require_coverage: bool = False,
) -> DataFrame:
    """What is enabled in every scope and why, also in scopes without any evaluation.

    scopes: scope, matches, teams, profiles. Coverage is complete where every team met every
    other at home: matches = teams x (teams - 1). With ``require_coverage`` incomplete scopes
    are never enabled."""
    target = clubs.where("target").select(*scope, "team_id").distinct()
    targets = target.groupBy(*scope).agg(F.count(F.lit(1)).alias("enabled_clubs"))
    at = grid.join(chosen.where(F.col("threshold").isNotNull()).select(*scope, "threshold", "roles"), [*scope, "threshold"])
    held = at.where(F.array_contains("roles", F.col("primary_role"))).groupBy(*scope).agg(
        F.sum("eligible_profiles").alias("eligible_profiles")
    )
    evaluated = grid.groupBy(*scope).agg(F.lit(True).alias("evaluated"))
    whole = F.coalesce(F.col("matches") == F.col("teams") * (F.col("teams") - 1), F.lit(False))
    table = (
        scopes.join(evaluated, list(scope), "left")
        .join(chosen, list(scope), "left")
        .join(held, list(scope), "left")
        .join(targets, list(scope), "left")
    )
    allowed = whole if require_coverage else F.lit(True)
    blocked = reason_list(
        (~allowed, "season_coverage_incomplete"),
        (F.col("evaluated").isNull(), "no_registered_evaluation"),
        (F.col("evaluated").isNotNull() & F.col("threshold").isNull(), "registered_gates_not_met"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return table.select(
        *scope, "matches", "teams", "profiles",
        F.when(whole, "complete").otherwise("partial").alias("coverage_status"),
        F.col("threshold"),
        F.coalesce("roles", F.array().cast("array<string>")).alias("roles"),
        zero("eligible_profiles"), zero("enabled_clubs"),
        (allowed & F.col("threshold").isNotNull() & (F.coalesce("enabled_clubs", F.lit(0)) > 0)).alias("recruitment_enabled"),
        F.coalesce(F.get(blocked, F.lit(0)), F.lit("registered_league_role_gates_passed")).alias("reason"),
    )
