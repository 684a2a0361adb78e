"""Requirement-based ranking (J1-J23): many scenarios in one job.

Tables: ``scenarios`` (scenario_id, club_id, target_role, minimum_minutes,
minimum_stability, exclude_same_club, candidate_team_id, replacement_player_id),
``requirements`` (scenario_id, feature_id, family, preference, value, weight,
family_weight, hard_constraint) and ``candidates`` (player_id, role, minutes,
team_ids, eligible, exclusions, neighbour_stability, percentiles map).
Both sides meet on the role, so a scenario only sees its own candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline.functions.constants import EPSILON, EXACT_TOLERANCE
from turfline.functions.measures import half_up, mismatch, reason_list, uniform_draw
from turfline.operators.ordering import row_index, top_k
from turfline.session import settle

POOL = ["scenario_id"]


def packed_requirements(requirements: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Active requirements of a scenario as one array, in feature order."""
    fields = ["feature_id", "family", "preference", "value", "weight", "hard_constraint"]
    weighted = requirements.where(F.col("preference") != "neutral").withColumn(
        "weight", F.col("weight") * F.coalesce("family_weight", F.lit(1.0)).cast("double")
    )
    return weighted.groupBy(*POOL, *extra).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("needs")
    )


def family_rms_weights(requirements: DataFrame) -> DataFrame:
    """Weights renormalised inside each family, times the family weight."""
    live = requirements.where(F.col("preference") != "neutral")
    raw = F.col("weight") * F.coalesce("family_weight", F.lit(1.0))
    total = F.sum(raw).over(Window.partitionBy(*POOL, "family"))
    return live.withColumn("weight", raw / total)


def judge(
    scenarios: DataFrame, needs: DataFrame, candidates: DataFrame, roles: Sequence[str] | None = None
) -> DataFrame:
    """Every candidate of a scenario with its sorted exclusion reasons.

    Candidates of other roles are ``wrong_role`` by definition, so a scenario only
    meets its own role -- unless the roles are listed to report those as well.
    """
    active = scenarios.join(needs, POOL, "left")
    if roles is None:
        met = active.join(candidates, active["target_role"] == candidates["role"])
    else:
        every = active.withColumn("_role", F.explode(F.array(*[F.lit(r) for r in roles])))
        met = every.join(candidates, F.col("_role") == F.col("role")).drop("_role")
    need = F.coalesce("needs", F.array().cast(needs.schema["needs"].dataType))
    value = lambda r: F.try_element_at("percentiles", r["feature_id"])
    per_feature = F.transform(
        need,
        lambda r: F.when(value(r).isNull(), F.lit("missing_required_feature")).when(
            r["hard_constraint"] & (mismatch(value(r), r["value"], r["preference"]) > EPSILON),
            F.concat(F.lit("hard_feature_constraint:"), r["feature_id"]),
        ),
    )
    low = F.col("neighbour_stability")
    fixed = reason_list(
        (F.col("role") != F.col("target_role"), "wrong_role"),
        (F.col("minutes") < F.col("minimum_minutes"), "below_minutes"),
        (
            (F.col("minimum_stability") > 0)
            & (low.isNull() | (low < F.col("minimum_stability"))),
            "below_evidence_threshold",
        ),
        (
            F.col("exclude_same_club") & F.array_contains("team_ids", F.col("club_id")),
            "same_club_excluded",
        ),
        (
            F.col("candidate_team_id").isNotNull()
            & ~F.array_contains("team_ids", F.coalesce("candidate_team_id", "club_id")),
            "candidate_team_filter",
        ),
        (F.col("player_id") == F.col("replacement_player_id"), "replacement_reference"),
    )
    own = F.when(~F.col("eligible"), F.col("exclusions")).otherwise(
        F.array().cast("array<string>")
    )
    reasons = F.array_sort(F.array_distinct(F.concat(own, fixed, F.array_compact(per_feature))))
    return met.withColumn("needs", need).withColumn("reasons", reasons)


def score(judged: DataFrame) -> DataFrame:
    """Losses, weighted RMS distance, unmet share and count of eligible rows."""
    value = lambda r: F.element_at("percentiles", r["feature_id"])
    tolerance = lambda r: F.when(r["preference"] == "exact", EXACT_TOLERANCE).otherwise(EPSILON)
    parts = F.transform(
        "needs",
        lambda r: F.struct(
            r["feature_id"].alias("feature_id"),
            r["family"].alias("family"),
            r["weight"].cast("double").alias("weight"),
            mismatch(value(r), r["value"], r["preference"]).alias("loss"),
            tolerance(r).alias("tolerance"),
        ),
    )
    fold = lambda f: F.aggregate("parts", F.lit(0.0), lambda a, p: a + f(p))
    rows = judged.where(F.size("reasons") == 0).withColumn("parts", parts)
    rows = rows.withColumns(
        {
            "weight_sum": fold(lambda p: p["weight"]),
            "squared": fold(lambda p: p["weight"] * p["loss"] * p["loss"]),
            "unmet_weight": fold(lambda p: F.when(p["loss"] > p["tolerance"], p["weight"]).otherwise(0.0)),
            "unmet": F.size(F.filter("parts", lambda p: p["loss"] > p["tolerance"])),
        }
    )
    share = lambda num: F.when(F.col("weight_sum") > 0, F.col(num) / F.col("weight_sum"))
    return rows.withColumns(
        {
            "distance": F.coalesce(F.sqrt(share("squared")), F.lit(0.0)),
            "unmet_share": F.coalesce(share("unmet_weight"), F.lit(0.0)),
            "losses": F.transform("parts", lambda p: p["loss"]),
        }
    )


def order_value(method: str, decimals: int = 6) -> Column:
    """One number to order by. hybrid puts the unmet count first; rounded
    distances of percentiles stay below 1000."""
    rounded = half_up(F.col("distance"), decimals)
    if method == "satisfaction":
        return F.col("unmet_share")
    if method == "hybrid":
        return F.col("unmet") * 1000.0 + rounded
    return rounded


# -- Pareto frontier -----------------------------------------------------------------------


def _undominated(losses: np.ndarray, by: np.ndarray, eps: float) -> np.ndarray:
    """Mask of rows of ``losses`` that no row of ``by`` dominates."""
    keep = np.ones(len(losses), dtype=bool)
    step = max(1, 2_000_000 // max(1, by.size))
    for i in range(0, len(losses), step):
        y = losses[i : i + step, None, :]
        beats = (by[None] <= y + eps).all(axis=2) & (by[None] < y - eps).any(axis=2)
        keep[i : i + step] = ~beats.any(axis=1)
    return keep


def _skyline(losses: np.ndarray, window: int = 512) -> np.ndarray:
    """Indices of the plain (eps 0) frontier of distinct rows: rows sorted by their
    sum can only be dominated by earlier ones."""
    order = np.argsort(losses.sum(axis=1), kind="stable")
    kept = np.empty((0, losses.shape[1]))
    chosen: list[np.ndarray] = []
    for i in range(0, len(order), window):
        part = order[i : i + window]
        rows = losses[part]
        ok = _undominated(rows, rows, 0.0)
        if len(kept):
            ok &= _undominated(rows, kept, 0.0)
        chosen.append(part[ok])
        kept = np.vstack([kept, rows[ok]])
    return np.concatenate(chosen) if chosen else np.empty(0, dtype=int)


def _local_frontiers(scored: DataFrame, keys: Sequence[str], ident: str, epsilon: float, size: int) -> DataFrame:
    """Rows of hashed parts of about ``size`` rows that none of their part dominates (``_kept``), and
    one row of each loss on the part's plain frontier (``_front``)."""
    rows = settle(scored.select(*keys, ident, "losses"), "losses")
    counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("_parts"))
    split = rows.join(counts, keys).withColumn("_part", F.pmod(F.xxhash64(ident), F.col("_parts")))
    flags = [T.StructField(n, T.BooleanType()) for n in ("_front", "_kept")]
    local = T.StructType([*split.schema.fields, *flags])

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        losses, first, same = np.unique(np.stack(pdf["losses"].to_numpy()), axis=0, return_index=True, return_inverse=True)
        front = _skyline(losses)
        keep = _undominated(losses, losses[front], epsilon)[same.ravel()]
        is_front = np.isin(np.arange(len(pdf)), first[front])
        return pdf.assign(_front=is_front, _kept=keep).loc[keep | is_front]

    return settle(split.groupBy(*keys, "_part").applyInPandas(within, local), "local_frontier")


def thinned(scored: DataFrame, keys: Sequence[str], ident: str, epsilon: float = EPSILON, size: int = 20_000) -> DataFrame:
    """(keys, ident, losses) without rows that others of their group dominate.

    Enough rows to find the frontier of any union of whole groups: what is left out is on none
    of them, and whatever it dominates a row that stays dominates as well."""
    return _local_frontiers(scored, list(keys), ident, epsilon, size).select(*keys, ident, "losses")


def pareto_frontier(
    scored: DataFrame, keys: Sequence[str], ident: str, epsilon: float = EPSILON, size: int = 20_000
) -> DataFrame:
    """Rows no other row of the group dominates, ties kept.

    A row that dominates with tolerance can be replaced by any row at least as
    good in every loss, so only plain local frontiers need to be asked. Groups are
    hashed into parts of about ``size`` rows: each part first drops its own
    dominated rows, then the survivors meet the frontiers of the other parts, part
    pair by part pair.
    """
    keys = list(keys)
    found = _local_frontiers(scored, keys, ident, epsilon, size)
    asked = (
        found.where(F.col("_kept") & (F.col("_parts") > 1))
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)))
        .where(F.col("_other") != F.col("_part"))
        .select(*keys, "_part", "_other", ident, "losses")
    )
    pairs = asked.select(*keys, "_part", "_other").distinct()
    fronts = found.where("_front").select(*keys, F.col("_part").alias("_other"), "losses")
    fronts = fronts.join(pairs, [*keys, "_other"])
    # Fresh column identities: both sides of the cogroup stem from one table.
    fronts = fronts.select(*[F.col(c).alias(c) for c in fronts.columns])
    beaten_schema = T.StructType([*[found.schema[k] for k in keys], found.schema[ident]])

    def beaten(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left.iloc[:0][beaten_schema.names]
        ok = _undominated(
            np.stack(left["losses"].to_numpy()), np.stack(right["losses"].to_numpy()), epsilon
        )
        return left.loc[~ok, beaten_schema.names]

    at = [*keys, "_part", "_other"]
    lost = asked.groupBy(*at).cogroup(fronts.groupBy(*at)).applyInPandas(beaten, beaten_schema)
    kept = found.where("_kept").select(*keys, ident)
    return kept.join(lost.distinct(), [*keys, ident], "left_anti")


# -- ranking -------------------------------------------------------------------------------


def rank_scenarios(
    scenarios: DataFrame, requirements: DataFrame, candidates: DataFrame, method: str = "weighted_rms",
    frontier: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rankings, exclusions, status per scenario); ``frontier`` adds J6 to the rankings."""
    used = family_rms_weights(requirements).withColumn("family_weight", F.coalesce("family_weight", F.lit(1.0))) if method == "family_rms" else requirements
    needs = packed_requirements(used)
    judged = settle(judge(scenarios, needs, candidates), "judged")
    scored = settle(score(judged).where(F.size("needs") > 0), "scored")
    ordered = row_index(
        scored.withColumn("_order", order_value(method)), POOL, "_order", "player_id", "rank"
    )
    if frontier:
        front = pareto_frontier(scored, POOL, "player_id").withColumn("_front", F.lit(True))
        ordered = ordered.join(front, [*POOL, "player_id"], "left")
    squares = lambda p: p["weight"] * p["loss"] * p["loss"]
    best = F.slice(F.array_sort(F.transform("parts", lambda p: F.struct(p["loss"], p["feature_id"]))), 1, 3)
    worst = F.slice(
        F.array_sort(
            F.transform(
                F.filter("parts", lambda p: p["loss"] > EPSILON),
                lambda p: F.struct((-squares(p)).alias("o"), p["feature_id"]),
            )
        ),
        1,
        3,
    )
    share = F.transform(
        "parts",
        lambda p: F.struct(
            p["feature_id"].alias("feature_id"),
            p["family"].alias("family"),
            F.when(F.col("squared") > 0, squares(p) / F.col("squared")).otherwise(0.0).alias("share"),
        ),
    )
    rankings = ordered.select(
        *POOL,
        "player_id",
        "rank",
        "distance",
        share.alias("contributions"),
        F.transform(best, lambda s: s["feature_id"]).alias("strong_matches"),
        F.transform(worst, lambda s: s["feature_id"]).alias("main_mismatches"),
        *([F.coalesce("_front", F.lit(False)).alias("frontier")] if frontier else []),
    )
    exclusions = judged.where(F.size("reasons") > 0).select(*POOL, "player_id", "reasons")
    counts = judged.groupBy(*POOL).agg(F.count_if(F.size("reasons") == 0).alias("eligible_count"))
    eligible = F.coalesce("eligible_count", F.lit(0))
    active = F.coalesce(F.size("needs"), F.lit(0))
    status = (
        scenarios.select(*POOL)
        .join(needs, POOL, "left")
        .join(counts, POOL, "left")
        .select(
            *POOL,
            F.when(active <= 0, "no_requirements").when(eligible == 0, "no_candidates").otherwise("ok").alias("status"),
            eligible.alias("eligible_count"),
            F.greatest(active, F.lit(0)).alias("active_requirements"),
        )
    )
    return rankings, exclusions, status


def family_contributions(rankings: DataFrame) -> DataFrame:
    """Contribution shares added up per family."""
    long = rankings.select(*POOL, "player_id", F.explode("contributions").alias("c"))
    return long.groupBy(*POOL, "player_id", "c.family").agg(F.sum("c.share").alias("share"))


def validate_scenarios(
    scenarios: DataFrame, requirements: DataFrame, clubs: DataFrame, candidates: DataFrame
) -> DataFrame:
    """Scenarios that break the contract or name unknown clubs or references."""
    known = clubs.select(F.col("club_id"), F.lit(True).alias("_club"))
    team = clubs.select(F.col("club_id").alias("candidate_team_id"), F.lit(True).alias("_team"))
    reference = candidates.select(
        F.col("player_id").alias("replacement_player_id"),
        F.struct("eligible", "team_ids", "role").alias("_ref"),
    )
    bad = requirements.groupBy(*POOL).agg(
        F.max(~F.col("value").between(0, 100)).alias("_value"),
        F.max(~F.col("weight").between(1, 3)).alias("_weight"),
        F.max(~F.col("preference").isin("exact", "minimum", "maximum", "neutral")).alias("_pref"),
        (F.count(F.lit(1)) > F.size(F.collect_set("feature_id"))).alias("_twice"),
    )
    fit = (
        F.col("_ref.eligible")
        & F.array_contains("_ref.team_ids", F.col("club_id"))
        & (F.col("_ref.role") == F.col("target_role"))
    )
    joined = (
        scenarios.join(known, "club_id", "left")
        .join(team, "candidate_team_id", "left")
        .join(reference, "replacement_player_id", "left")
        .join(bad, POOL, "left")
    )
    reasons = reason_list(
        (
            F.col("_club").isNull() | (F.col("candidate_team_id").isNotNull() & F.col("_team").isNull()),
            "unknown_club",
        ),
        (
            F.col("replacement_player_id").isNotNull() & ~F.coalesce(fit, F.lit(False)),
            "invalid_replacement_reference",
        ),
        (F.col("_value"), "value_outside_percentiles"),
        (F.col("_weight"), "weight_outside_contract"),
        (F.col("_pref"), "unknown_preference"),
        (F.col("_twice"), "duplicate_feature"),
    )
    return joined.select(*POOL, reasons.alias("reasons")).where(F.size("reasons") > 0)


# Research requirements (feature, preference, percentile).
RESEARCH_REQUIREMENTS = [
    ("shots_per90", "minimum", 75.0),
    ("passes_per90", "minimum", 70.0),
    ("pressures_per90", "minimum", 75.0),
]


def replacement_requirements(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A reference player's percentiles as exact requirements."""
    return candidates.select(*keys, F.explode("percentiles").alias("feature_id", "value")).select(
        *keys,
        "feature_id",
        F.lit("exact").alias("preference"),
        "value",
        F.lit(1.0).alias("weight"),
        F.lit(False).alias("hard_constraint"),
    )


# -- stability ---------------------------------------------------------------------------


def perturbed_requirements(requirements: DataFrame, draws: int, seed: str, low=0.8, high=1.2) -> DataFrame:
    """Per draw and feature a hash-to-uniform weight factor."""
    drawn = requirements.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    factor = uniform_draw(low, high, F.lit(seed), "draw", "feature_id")
    return drawn.withColumn("weight", F.col("weight") * factor)


def rank_summary(
    reference: DataFrame, drawn: DataFrame, keys: Sequence[str], ident: str, k: int, draws: int
) -> tuple[DataFrame, DataFrame]:
    """(mean top-k overlap per key, inclusion and rank spread per row).

    reference and drawn carry ``rank``; drawn also ``draw``. The rank quantiles run
    over at most ``draws`` values per row.
    """
    keys = list(keys)
    size = reference.groupBy(*keys).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("_k"))
    top = reference.join(size, keys).where(F.col("rank") <= F.col("_k")).select(*keys, ident, F.lit(1).alias("_top"))
    placed = drawn.join(size, keys).withColumn("_in", F.col("rank") <= F.col("_k"))
    hits = placed.where("_in").join(top, [*keys, ident]).groupBy(*keys, "draw").agg(
        F.count(F.lit(1)).alias("_common")
    )
    grid = size.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    common = F.coalesce("_common", F.lit(0))
    overlaps = grid.join(hits, [*keys, "draw"], "left").groupBy(*keys).agg(
        F.avg(common / (2 * F.col("_k") - common)).alias("mean_jaccard")
    )
    bounds = F.percentile("rank", F.array(F.lit(0.1), F.lit(0.9)))
    rows = placed.groupBy(*keys, ident).agg(
        F.avg(F.col("_in").cast("double")).alias("top_k_inclusion"), bounds.alias("b")
    )
    return overlaps, rows.select(
        *keys, ident, "top_k_inclusion", F.col("b")[0].alias("rank_p10"), F.col("b")[1].alias("rank_p90")
    )


def weight_stability(
    scored: DataFrame, requirements: DataFrame, draws: int, seed: str, k: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Rank stability under weight perturbations. Losses do not depend on the
    weights, so they are computed once; a draw only re-weights them."""
    factors = (
        perturbed_requirements(requirements.where(F.col("preference") != "neutral"), draws, seed)
        .withColumn("weight", F.col("weight") * F.coalesce("family_weight", F.lit(1.0)))
        .groupBy(*POOL, "draw")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("feature_id", "weight"))), lambda s: s["weight"]
            ).alias("w")
        )
    )
    total = F.aggregate("w", F.lit(0.0), lambda a, w: a + w)
    squares = F.aggregate(
        F.zip_with("w", "losses", lambda w, x: w * x * x), F.lit(0.0), lambda a, v: a + v
    )
    slim = settle(scored.select(*POOL, "player_id", "losses", "distance"), "losses")
    drawn = slim.join(factors, POOL).withColumn("_order", half_up(F.sqrt(squares / total), 6))
    ranked = row_index(
        drawn.select(*POOL, "draw", "player_id", "_order"), [*POOL, "draw"], "_order", "player_id", "rank"
    )
    reference = row_index(
        slim.withColumn("_order", half_up(F.col("distance"), 6)), POOL, "_order", "player_id", "rank"
    )
    return rank_summary(reference, settle(ranked, "ranked"), POOL, "player_id", k, draws)


def quantised(percentile: Column, scale: int = 10) -> Column:
    """Percentile as an integer in tenths, half up."""
    return F.floor(percentile * scale + 0.5).cast("int")


# -- context and hold-out evaluations ---------------------------------------------------------


def leave_one_out(
    totals: DataFrame, own: DataFrame, keys: Sequence[str], ident: str, counts: Sequence[str]
) -> DataFrame:
    """Team totals without one player: subtract, never below zero."""
    renamed = own.select(*keys, ident, *[F.col(c).alias(f"_own_{c}") for c in counts])
    return totals.join(renamed, list(keys)).select(
        *keys,
        ident,
        *[F.greatest(F.lit(0.0), F.col(c) - F.coalesce(F.col(f"_own_{c}"), F.lit(0.0))).alias(c) for c in counts],
    )


def holdout_middles(ladder: DataFrame, members: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The middle values of a group without one member, for every member.

    Leaving one value out moves the middle by at most one place, so three middle
    values per group serve all members; nothing is rebuilt per member. Adds mid_low,
    mid_high and the number of mates; members alone in their group have no row.
    """
    low = F.floor((F.col("n_total") - 2) / 2)
    at = lambda p: F.max(
        F.when((F.col("n_below") <= p) & (p < F.col("n_below") + F.col("n")), F.col(value))
    )
    middle = ladder.groupBy(*keys).agg(
        F.array(at(low), at(low + 1), at(low + 2)).alias("_mid"), F.max("n_total").alias("_n")
    )
    placed = (
        members.join(ladder.select(*keys, value, "n_below"), [*keys, value])
        .join(middle, list(keys))
        .where(F.col("_n") > 1)
    )
    first, last = F.floor((F.col("_n") - 2) / 2), F.ceil((F.col("_n") - 2) / 2)
    pick = lambda p: F.element_at(
        "_mid", (p + F.when(p >= F.col("n_below"), 1).otherwise(0) - first + 1).cast("int")
    )
    return placed.select(*members.columns, pick(first).alias("mid_low"), pick(last).alias("mid_high"), (F.col("_n") - 1).alias("mates"))


def holdout_medians(ladder: DataFrame, members: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median of a group without one member, for every member."""
    middles = holdout_middles(ladder, members, keys, value)
    return middles.select(*members.columns, ((F.col("mid_low") + F.col("mid_high")) / 2).alias("mates_median"))


def metric_rollup(ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank percentile, reciprocal rank and pool size per method, role and overall."""
    place = F.when(F.col("candidates") > 1, 1 - (F.col("rank") - 1) / (F.col("candidates") - 1))
    return ranks.rollup(*keys).agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg(1.0 / F.col("rank")).alias("mrr"),
        F.avg(place).alias("rank_percentile"),
        F.avg("candidates").alias("mean_candidates"),
    )


def select_method(summary: DataFrame, order: Sequence[str], floor: float = 0.65) -> DataFrame:
    """The first method of ``order`` that retrieves above random and is stable enough;
    the row that is asked for raises an error if none is."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method"))
    passed = summary.where((place > 0) & (F.col("mrr") > F.col("random_mrr")) & (F.col("jaccard") >= floor))
    none = F.raise_error(F.lit("no method passes the development gate")).cast("string")
    return passed.agg(F.min_by("method", place).alias("first")).select(F.coalesce("first", none).alias("method"))


def gate(summary: DataFrame, order: Sequence[str], floor: float = 0.65) -> DataFrame:
    """Every method's measured figures with whether it may be chosen and whether it is: the
    first of ``order`` that retrieves above random and is stable enough. No method may pass."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method"))
    fit = (F.col("mrr") > F.col("random_mrr")) & (F.col("weight_jaccard") >= floor)
    judged = summary.withColumn("eligible", fit)
    first = judged.agg(F.min(F.when(F.col("eligible") & (place > 0), place)).alias("_first"))  # one row
    chosen = F.col("eligible") & (place > 0) & F.coalesce(place == F.col("_first"), F.lit(False))
    return judged.join(F.broadcast(first)).withColumn("selected", chosen).drop("_first")


def native_ranking(
    candidates: DataFrame, needs: DataFrame, scales: DataFrame, pool: Sequence[str]
) -> DataFrame:
    """Raw values against near / at_least / at_most targets in league scales.

    candidates: scenario_id, player_id, feature, value; needs: scenario_id, feature,
    target, mode, weight; scales: scale per feature, or per league and feature. Duplicate
    players of a wider pool keep their best row.
    """
    own = [c for c in ("league", "feature") if c in scales.columns]
    joined = candidates.join(needs, [*pool, "feature"]).join(scales, own)
    gap = (F.col("value") - F.col("target")) / F.col("scale")
    loss = (
        F.when(F.col("mode") == "at_least", F.greatest(F.lit(0.0), -gap))
        .when(F.col("mode") == "at_most", F.greatest(F.lit(0.0), gap))
        .otherwise(F.abs(gap))
    )
    scored = joined.groupBy(*pool, "player_id", "league").agg(
        F.sqrt(F.sum(F.col("weight") * loss * loss) / F.sum("weight")).alias("distance")
    )
    best = scored.groupBy(*pool, "player_id").agg(
        F.min_by("league", F.struct("distance", "league")).alias("league"),
        F.min("distance").alias("distance"),
    )
    return best


def asof_universe(rows: DataFrame, decisions: DataFrame, key: str, counts: Sequence[str]) -> DataFrame:
    """Season totals of each key from rows up to the decision date only.

    Cumulative sums per (key, day) are carried to the decision days, so rows are
    never multiplied by the decisions. A key gets only the days from its first row on,
    each of which is a row of the result. The days are one row of distinct calendar
    dates, 4 bytes each, whatever the number of decisions.
    """
    names = ["minutes", "appearances", *counts]
    daily = rows.where(F.col("reliable") & (F.col("minutes") > 0)).groupBy(key, F.col("observed_on").alias("day")).agg(
        F.sum("minutes").alias("minutes"),
        F.count(F.lit(1)).cast("double").alias("appearances"),
        *[F.sum(c).alias(c) for c in counts],
    )
    starts = daily.groupBy(key).agg(F.min("day").alias("_start"))
    days = decisions.select(F.collect_set(F.col("decision_date").cast("date")).alias("d"))  # one row
    marks = starts.join(F.broadcast(days)).select(
        key, F.explode(F.filter("d", lambda d: d >= F.col("_start"))).alias("day")
    )
    line = daily.withColumn("decision", F.lit(None).cast("date")).unionByName(
        marks.select(
            key, "day", *[F.lit(0.0).alias(n) for n in names], F.col("day").alias("decision")
        )
    )
    merged = line.groupBy(key, "day").agg(
        *[F.sum(n).alias(n) for n in names], F.max("decision").alias("decision")
    )
    upto = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    running = merged.select(key, "decision", *[F.sum(n).over(upto).alias(n) for n in names])
    return running.where(F.col("decision").isNotNull() & (F.col("minutes") > 0))


def top_ranked(rankings: DataFrame, k: int) -> DataFrame:
    """Top-k report of every scenario."""
    return top_k(rankings, POOL, ["rank"], k, "place").drop("place")
