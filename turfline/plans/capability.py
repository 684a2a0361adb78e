"""Threshold grid, provider summary and capability table: I11, I19."""

from __future__ import annotations

from pyspark.sql import functions as F

from turfline.operators import capability as C
from turfline.operators import evaluation as E
from turfline.operators import profiles as P
from turfline.operators import timesplit as G
from turfline.plans.profiles import RATES, rounded
from turfline.plans.registry import query
from turfline.plans.similarity import FAM, FAMILY_CASE
from turfline.plans.timesplit import HALF_TOTALS
from turfline.plans.views import PM_COUNTS
from turfline.session import settle

THRESHOLDS = (200, 300, 400)
SCOPE, DRAWS, PAIRS, MEMBERS = ["competition_id"], 20, 20, 2
CELL = [*SCOPE, "threshold", "primary_role"]


def cohorts(v):
    """(eligible, pairs): profiles and alternating halves at every threshold."""
    eligible = settle(C.eligible_profiles(v.pf, THRESHOLDS, RATES), "eligible")
    ordered = G.alternating_split(P.usable(v.pm), ["player_id"], ["observed_on", "match_id"], G.month_of("observed_on"))
    halves = P.season_profiles(ordered, ["player_id", "half"], PM_COUNTS)
    return eligible, settle(C.eligible_pairs(eligible, halves, SCOPE, "player_id", RATES), "pairs")


def grid(v):
    eligible, pairs = cohorts(v)
    return eligible, settle(C.threshold_grid(eligible, pairs, SCOPE, "player_id", FAM, DRAWS, PAIRS), "grid")


G_ = "competition_id, threshold, primary_role"
FULL = " AND ".join(f"{c} IS NOT NULL" for c in RATES)
GRID_SQL = f"""el AS (SELECT pf.*, t.threshold FROM pf JOIN (VALUES {", ".join(f"({t}e0)" for t in THRESHOLDS)}) t(threshold) ON minutes >= t.threshold
  WHERE primary_role IS NOT NULL AND primary_role <> 'GK' AND {FULL}),
ah AS (SELECT *, (row_number() OVER (PARTITION BY player_id ORDER BY observed_on, match_id) - 1) % 2 AS half FROM pm WHERE reliable),
hv AS (SELECT player_id, half, sum(minutes) AS minutes, {HALF_TOTALS} FROM ah GROUP BY ALL),
lo AS (SELECT player_id, min(minutes) AS low FROM hv WHERE {FULL} GROUP BY player_id HAVING count(*) = 2),
pr AS (SELECT {G_}, player_id FROM el JOIN lo USING (player_id) WHERE low >= threshold / 2),
gl AS ({" UNION ALL ".join(f"SELECT pr.*, half, '{c}' AS feature, {c} AS value FROM pr JOIN hv USING (player_id)" for c in RATES)}),
gs AS (SELECT {G_}, feature, {FAMILY_CASE} AS family, stddev_pop(value) AS sd FROM gl WHERE half = 0 GROUP BY ALL HAVING stddev_pop(value) >= 1e-10),
gf AS (SELECT {G_}, count(DISTINCT family) AS families FROM gs GROUP BY ALL),
gw AS (SELECT gs.*, 1e0 / (families * count(*) OVER (PARTITION BY {G_}, family)) AS w FROM gs JOIN gf USING ({G_})),
gd AS (SELECT a.competition_id, a.threshold, a.primary_role, a.player_id, b.player_id AS other, sqrt(coalesce(sum(w * pow((a.value - b.value) / sd, 2)), 0)) AS d
  FROM gl a JOIN gl b ON a.half = 0 AND b.half = 1 AND a.competition_id = b.competition_id AND a.threshold = b.threshold AND a.primary_role = b.primary_role AND a.feature = b.feature
  LEFT JOIN gw ON gw.competition_id = a.competition_id AND gw.threshold = a.threshold AND gw.primary_role = a.primary_role AND gw.feature = a.feature GROUP BY ALL),
gr AS (SELECT competition_id, threshold, primary_role, player_id, count(*) FILTER (WHERE d < own - 1e-10) AS earlier, count(*) FILTER (WHERE abs(d - own) <= 1e-10) AS tied, count(*) AS n
  FROM (SELECT *, max(CASE WHEN other = player_id THEN d END) OVER (PARTITION BY {G_}, player_id) AS own FROM gd) z GROUP BY ALL),
gt AS (SELECT *, list_sum(list_transform(range(earlier + 1, earlier + tied + 1), lambda i: 1e0 / i)) / tied AS rr,
  least(greatest(5 - earlier, 0), tied) / CAST(tied AS DOUBLE) AS t5, least(greatest(10 - earlier, 0), tied) / CAST(tied AS DOUBLE) AS t10,
  row_number() OVER (PARTITION BY {G_} ORDER BY earlier, player_id) AS place FROM gr),
gk AS (SELECT g.draw, {G_}, CAST('0x' || substr(md5('grid:' || g.draw || ':' || competition_id || ':' || printf('%.1f', threshold) || ':' || primary_role || ':' || place), 1, 15) AS BIGINT) % n + 1 AS place FROM gt, range(1, {DRAWS + 1}) g(draw)),
gm AS (SELECT draw, {G_}, avg(rr) AS m FROM gk JOIN gt USING ({G_}, place) GROUP BY ALL),
gb AS (SELECT {G_}, quantile_cont(m, 0.025) AS mrr_low, quantile_cont(m, 0.975) AS mrr_high FROM gm GROUP BY ALL),
ga AS (SELECT a.competition_id, a.threshold, a.primary_role, a.feature, a.value AS x, b.value AS y FROM gl a JOIN gl b USING ({G_}, feature, player_id) WHERE a.half = 0 AND b.half = 1),
gq AS (SELECT {G_}, feature, rank() OVER (PARTITION BY {G_}, feature ORDER BY x) + (count(*) OVER (PARTITION BY {G_}, feature, x) - 1) / 2e0 AS rx,
  rank() OVER (PARTITION BY {G_}, feature ORDER BY y) + (count(*) OVER (PARTITION BY {G_}, feature, y) - 1) / 2e0 AS ry FROM ga),
gc AS (SELECT {G_}, feature, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS s FROM gq GROUP BY ALL),
gv AS (SELECT {G_}, quantile_cont(s, 0.5) AS median_spearman, count(s) AS nonconstant_features FROM gc GROUP BY ALL),
gx AS (SELECT {G_}, count(*) AS queries, avg(t5) AS recall5, avg(t10) AS recall10, avg(rr) AS mrr, least(5, count(*)) / CAST(count(*) AS DOUBLE) AS random_recall5,
  least(10, count(*)) / CAST(count(*) AS DOUBLE) AS random_recall10, list_sum(list_transform(range(1, count(*) + 1), lambda i: 1e0 / i)) / count(*) AS random_mrr FROM gt GROUP BY ALL),
ge AS (SELECT {G_}, count(*) AS eligible_profiles FROM el GROUP BY ALL),
gj AS (SELECT ge.*, coalesce(queries, 0) AS queries, recall5, recall10, mrr, random_recall5, random_recall10, random_mrr,
  mrr_low, mrr_high, median_spearman, nonconstant_features FROM ge LEFT JOIN gx USING ({G_}) LEFT JOIN gb USING ({G_}) LEFT JOIN gv USING ({G_})),
gg AS (SELECT *, CASE WHEN queries < 2 THEN 'insufficient_pairs' ELSE array_to_string(list_filter([CASE WHEN queries < {PAIRS} THEN 'fewer_than_registered_role_pairs' END,
  CASE WHEN median_spearman IS NULL OR median_spearman < 0.35 THEN 'profile_stability_below_registered_floor' END,
  CASE WHEN recall5 < 1.5 * random_recall5 THEN 'recall5_below_registered_random_multiple' END,
  CASE WHEN mrr < 1.5 * random_mrr THEN 'mrr_below_registered_random_multiple' END], lambda z: z IS NOT NULL), ';') END AS reasons FROM gj),
ch AS (SELECT competition_id, min(threshold) AS threshold FROM (SELECT competition_id, threshold FROM gg GROUP BY ALL HAVING count(*) FILTER (WHERE reasons = '') >= 2) q GROUP BY competition_id),
en AS (SELECT competition_id, threshold, primary_role, eligible_profiles FROM gg JOIN ch USING (competition_id, threshold) WHERE reasons = ''),
tm AS (SELECT competition_id, player_id, team_id FROM pm WHERE reliable GROUP BY ALL HAVING sum(minutes) >= 90),
cr AS (SELECT competition_id, team_id, primary_role, count(*) AS members, count(*) >= {MEMBERS} AS target FROM el JOIN en USING (competition_id, threshold, primary_role) JOIN tm USING (competition_id, player_id) GROUP BY ALL)"""
FIGURES = ["recall5", "recall10", "mrr", "random_recall5", "random_recall10", "random_mrr", "mrr_low", "mrr_high", "median_spearman"]
# A billionth more keeps both engines on one side of a rounding tie.
BLANKED = ", ".join(f"round(CASE WHEN queries >= 2 THEN {c} END + 1e-9, 6) AS {c}" for c in FIGURES)


@query(
    "league_threshold_grid",
    "I19 I11",
    f"""WITH {GRID_SQL} SELECT {G_}, eligible_profiles, queries, {BLANKED}, CASE WHEN queries >= 2 THEN nonconstant_features END AS nonconstant_features, reasons, reasons = '' AS passed FROM gg""",
    "pf pm",
)
def league_threshold_grid(v):
    """Cohort, retrieval, bootstrap interval and gate of every league, threshold and role."""
    out = grid(v)[1].withColumn("reasons", F.array_join("reasons", ";"))
    names = [*CELL, "eligible_profiles", "queries", *FIGURES, "nonconstant_features", "reasons", "passed"]
    return out.select(*names).withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in FIGURES})


WEIGHTED = ", ".join(f"round(sum({c} * queries) / sum(queries), 6) AS {c}" for c in ("recall5", "recall10", "mrr", "random_recall5", "random_mrr"))


@query(
    "provider_retrieval",
    "I11",
    f"""WITH {GRID_SQL} SELECT CASE WHEN competition_id = 0 THEN 'p' ELSE 'q' END AS provider, threshold, count(*) AS cells, CAST(sum(queries) AS BIGINT) AS pairs, {WEIGHTED},
  count(*) FILTER (WHERE reasons = '') AS passing FROM gg WHERE queries >= {PAIRS} GROUP BY ALL""",
    "pf pm",
)
def provider_retrieval(v):
    """Half-to-half retrieval of the scopes of each provider with enough pairs, by threshold."""
    rows = grid(v)[1].withColumn("provider", F.when(F.col("competition_id") == 0, "p").otherwise("q"))
    return rounded(C.provider_summary(rows, "provider", PAIRS), "recall5", "recall10", "mrr", "random_recall5", "random_mrr")


def decided(v):
    """(grid, chosen, clubs) of all leagues."""
    eligible, table = grid(v)
    chosen = settle(E.first_passing_threshold(table, SCOPE), "chosen")
    minutes = P.usable(v.pm).groupBy(*SCOPE, "player_id", "team_id").agg(F.sum("minutes").alias("minutes"))
    return table, chosen, C.club_roles(eligible, chosen, minutes, SCOPE, "player_id", 90.0, MEMBERS)


@query("club_role_capability", "I19", f"WITH {GRID_SQL} SELECT competition_id, team_id, primary_role, members, target FROM cr", "pf pm")
def club_role_capability(v):
    """Members of every club in the roles that its league enables."""
    return decided(v)[2]


@query(
    "capability_table",
    "I19",
    f"""WITH {GRID_SQL},
sc AS (SELECT competition_id, count(DISTINCT match_id) AS matches, count(DISTINCT team_id) AS teams FROM pm GROUP BY ALL),
sp AS (SELECT competition_id, count(*) AS profiles FROM pf GROUP BY ALL)
SELECT competition_id, matches, teams, profiles, CASE WHEN matches = teams * (teams - 1) THEN 'complete' ELSE 'partial' END AS coverage_status, ch.threshold,
  coalesce((SELECT string_agg(primary_role, ',' ORDER BY primary_role) FROM en WHERE en.competition_id = sc.competition_id), '') AS roles,
  CAST(coalesce((SELECT sum(eligible_profiles) FROM en WHERE en.competition_id = sc.competition_id), 0) AS BIGINT) AS eligible_profiles,
  (SELECT count(DISTINCT team_id) FROM cr WHERE target AND cr.competition_id = sc.competition_id) AS enabled_clubs,
  ch.threshold IS NOT NULL AND EXISTS (SELECT 1 FROM cr WHERE target AND cr.competition_id = sc.competition_id) AS recruitment_enabled,
  CASE WHEN competition_id NOT IN (SELECT competition_id FROM gg) THEN 'no_registered_evaluation' WHEN ch.threshold IS NULL THEN 'registered_gates_not_met' ELSE 'registered_league_role_gates_passed' END AS reason
FROM sc LEFT JOIN sp USING (competition_id) LEFT JOIN ch USING (competition_id)""",
    "pf pm",
)
def capability_table(v):
    """Threshold, roles, clubs and reason of every league."""
    table, chosen, clubs = decided(v)
    pairs = v.pm.groupBy(*SCOPE).agg(F.countDistinct("match_id").alias("matches"), F.countDistinct("team_id").alias("teams"))
    scopes = pairs.join(v.pf.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("profiles")), SCOPE, "left")
    out = C.capability_table(scopes, table, chosen, clubs, SCOPE)
    return out.withColumn("roles", F.array_join("roles", ","))
