"""Profile queries: F4-F23, H8, H9."""

from __future__ import annotations

from pyspark.sql import functions as F

from turfline.operators import profiles as P
from turfline.operators.ordering import group_quantiles, with_midrank, with_reference_midrank
from turfline.plans.registry import query
from turfline.plans.views import PM_COUNTS

RATES = [f"{c}_per90" for c in PM_COUNTS]
RATE_LIST = ", ".join(f"round({c}, 6) AS {c}" for c in RATES)
PM_TOTALS = ", ".join(
    f"CASE WHEN count({c})=count(*) THEN sum({c}) END AS {c}"
    for c in [*PM_COUNTS, "own_possessions", "opponent_possessions"]
)
LONG_CO = " UNION ALL ".join(
    f"SELECT player_id, primary_role, club_id, minutes, '{c}' AS feature, {c} AS value FROM co" for c in RATES
)


def rounded(df, *names, places=6):
    return df.withColumns({c: F.round(c, places) for c in names})


@query(
    "season_profiles",
    "F4 F6 E6 H9",
    f"SELECT player_id, minutes, competition_id, club_id, appearances, primary_role, {RATE_LIST} FROM pf",
    "pf",
)
def season_profiles(v):
    return rounded(v.pf, *RATES)


@query(
    "derived_ratios",
    "F4 F5",
    f"""WITH t AS (SELECT player_id, sum(minutes) AS minutes, {PM_TOTALS} FROM pm WHERE reliable GROUP BY player_id)
SELECT player_id, round(CASE WHEN opponent_possessions > 0 THEN 100e0 * pressures / opponent_possessions END, 6) AS pressures_per100_opponent,
 round(CASE WHEN opponent_possessions > 0 THEN 100e0 * tackles / opponent_possessions END, 6) AS interceptions_per100_opponent,
 round(CASE WHEN own_possessions > 0 THEN 100e0 * progressive_passes / own_possessions END, 6) AS progressive_passes_per100_team,
 round(CASE WHEN passes > 0 THEN carries / passes END, 6) AS pass_completion FROM t""",
    "pm",
)
def derived_ratios(v):
    totals = P.season_totals(
        v.pm, ["player_id"], [*PM_COUNTS, "own_possessions", "opponent_possessions"]
    ).withColumns(
        {
            "npxg": F.col("shots"),
            "xa": F.col("shots"),
            "completed_passes": F.col("carries"),
            "interceptions": F.col("tackles"),
            "team_passes": F.col("passes"),
        }
    )
    names = [
        "pressures_per100_opponent",
        "interceptions_per100_opponent",
        "progressive_passes_per100_team",
        "pass_completion",
    ]
    return rounded(P.derived_values(totals).select("player_id", *names), *names)


ROLE_SQL = """
WITH t AS (SELECT player_id, sum(minutes) AS total FROM pm WHERE reliable GROUP BY player_id),
m AS (SELECT player_id, role, sum(minutes) AS m FROM pm WHERE reliable AND role <> 'unknown' GROUP BY player_id, role),
s AS (SELECT player_id, role, m / total AS share, row_number() OVER (PARTITION BY player_id ORDER BY m DESC, role) AS place
      FROM m JOIN t USING (player_id)),
a AS (SELECT player_id, sum(share) AS known, max(CASE WHEN place=1 THEN role END) AS r1,
  max(CASE WHEN place=2 THEN role END) AS r2, max(CASE WHEN place=1 THEN share END) AS s1,
  -sum(share * ln(share)) AS entropy FROM s GROUP BY player_id)
SELECT player_id, CASE WHEN known >= 0.6e0 AND s1 >= 0.4e0 THEN r1 END AS primary_role, r2 AS secondary_role,
  round(known, 6) AS known_role_share, s1 < 0.7e0 AS multi_role, round(entropy, 6) AS role_entropy FROM a
"""


@query("role_summary", "F6", ROLE_SQL, "pm")
def role_summary(v):
    out = P.role_summary(P.observation_roles(P.usable(v.pm), ["player_id"]), ["player_id"])
    return rounded(out.drop("role_shares"), "known_role_share", "role_entropy")


REASONS = """list_filter([CASE WHEN minutes < {t} THEN 'below_minutes' END,
  CASE WHEN primary_role IS NULL THEN 'uncertain_role' END,
  CASE WHEN primary_role = 'GK' THEN 'goalkeeper_excluded' END,
  CASE WHEN shot_assists_per90 IS NULL THEN 'missing_core_features' END], lambda z: z IS NOT NULL)"""


@query(
    "eligibility_reasons",
    "F8",
    f"SELECT player_id, array_to_string({REASONS.format(t=450)}, ';') AS reasons FROM pf",
    "pf",
)
def eligibility_reasons(v):
    reasons = P.eligibility_reasons(F.lit(450), RATES)
    return v.pf.select("player_id", F.array_join(reasons, ";").alias("reasons"))


SWEEP = f"""WITH sweep AS (SELECT threshold, primary_role, {REASONS.format(t="threshold")} AS reasons
  FROM pf JOIN (VALUES (200e0), (300e0), (450e0), (600e0)) h(threshold) ON TRUE)"""


@query(
    "eligibility_sweep",
    "F9",
    SWEEP
    + " SELECT threshold, primary_role, count(*) AS players, count(*) < 12 AS sparse_role FROM sweep"
    " WHERE len(reasons) = 0 GROUP BY ALL",
    "pf",
)
def eligibility_sweep(v):
    return P.threshold_sweep(v.pf, RATES, [200, 300, 450, 600])[0]


@query(
    "exclusion_histogram",
    "F9 F22",
    SWEEP + " SELECT threshold, reason, count(*) AS n FROM (SELECT threshold, unnest(reasons) AS reason FROM sweep) GROUP BY ALL",
    "pf",
)
def exclusion_histogram(v):
    return P.threshold_sweep(v.pf, RATES, [200, 300, 450, 600])[1]


@query(
    "threshold_counts",
    "F22",
    "SELECT count(*) FILTER (WHERE minutes >= 300) AS at_300, count(*) FILTER (WHERE minutes >= 450) AS at_450,"
    " count(*) FILTER (WHERE minutes >= 600) AS at_600 FROM pf",
    "pf",
)
def threshold_counts(v):
    return P.threshold_counts(v.pf, [300, 450, 600])


@query(
    "comparison_cohort",
    "F9",
    "SELECT primary_role, player_id, minutes, role_size FROM co",
    "co",
)
def comparison_cohort(v):
    return v.co.select("primary_role", "player_id", "minutes", "role_size")


@query(
    "cohort_quantiles",
    "F10",
    """SELECT measure, round(quantile_cont(value, 0), 6) AS minimum, round(quantile_cont(value, 0.25), 6) AS q25,
 round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 1), 6) AS maximum
FROM (SELECT 'minutes' AS measure, minutes AS value FROM pf UNION ALL SELECT 'appearances', CAST(appearances AS DOUBLE) FROM pf) z
GROUP BY measure""",
    "pf",
)
def cohort_quantiles(v):
    probs = {"minimum": 0.0, "q25": 0.25, "median": 0.5, "p90": 0.9, "maximum": 1.0}
    quantiles, _ = P.cohort_report(v.pf, ["minutes", "appearances"], RATES, probs)
    return rounded(quantiles, *probs)


@query(
    "feature_availability",
    "F10",
    " UNION ALL ".join(
        f"SELECT count(*) AS n, '{c}' AS feature, count({c}) AS available FROM pf" for c in RATES
    ),
    "pf",
)
def feature_availability(v):
    return P.availability(v.pf, RATES)


SCOPED_COMMON = ["c_shots", "c_passes", "c_completed", "c_outcome_missing", "c_geometry_missing", "c_long",
                 "c_progressive", "c_final_third", "c_box"]
OBS_SQL = """obs AS (SELECT 'p' AS provider, CAST(competition_id AS VARCHAR) || '-' || CAST(season AS VARCHAR) AS scope,
  player_id, match_id, observed_on AS date, team_id, minutes, reliable,
  CASE WHEN reliable THEN NULL ELSE CASE WHEN match_id % 2 = 0 THEN 'invalid_roster' ELSE 'card_before_entry' END END AS reason,
  CASE WHEN role IN ('CB','FB/WB') THEN 'DEF' WHEN role = 'CM' THEN 'MID' WHEN role IN ('W','ST') THEN 'FWD'
       WHEN role = 'GK' THEN 'GK' END AS role_family,
  shots AS c_shots, passes AS c_passes, carries AS c_completed,
  CASE WHEN match_id % 53 = 0 THEN 1e0 ELSE 0e0 END AS c_outcome_missing,
  CASE WHEN match_id % 59 = 0 THEN 1e0 ELSE 0e0 END AS c_geometry_missing,
  tackles AS c_long, progressive_passes AS c_progressive, pressures AS c_final_third, box_shots AS c_box,
  shot_assists AS n_assists FROM pm)"""


def scoped_rows(v):
    family = P.role_family("role")
    return v.pm.select(
        F.lit("p").alias("provider"),
        F.concat_ws("-", "competition_id", "season").alias("scope"),
        "player_id",
        "match_id",
        F.col("observed_on").alias("date"),
        "team_id",
        "minutes",
        F.col("minutes").alias("elapsed_minutes"),
        "reliable",
        F.when(F.col("reliable"), F.array().cast("array<string>"))
        .otherwise(
            F.array(F.when(F.col("match_id") % 2 == 0, "invalid_roster").otherwise("card_before_entry"))
        )
        .alias("reasons"),
        family.alias("role_family"),
        F.create_map("role", "minutes").alias("role_minutes"),
        F.col("shots").alias("c_shots"),
        F.col("passes").alias("c_passes"),
        F.col("carries").alias("c_completed"),
        F.when(F.col("match_id") % 53 == 0, 1.0).otherwise(0.0).alias("c_outcome_missing"),
        F.when(F.col("match_id") % 59 == 0, 1.0).otherwise(0.0).alias("c_geometry_missing"),
        F.col("tackles").alias("c_long"),
        F.col("progressive_passes").alias("c_progressive"),
        F.col("pressures").alias("c_final_third"),
        F.col("box_shots").alias("c_box"),
        F.col("shot_assists").alias("n_assists"),
    )


SCOPED_SQL = """
WITH {obs},
a AS (SELECT scope, player_id, coalesce(sum(minutes) FILTER (WHERE reliable), 0) AS minutes, count(*) AS appearances,
  count(DISTINCT role_family) AS families, min(role_family) AS fam, bool_or(NOT reliable) AS withheld,
  bool_or(reason = 'invalid_roster') AS r1, bool_or(reason = 'card_before_entry') AS r2,
  sum(c_shots) AS s, sum(c_passes) AS p, sum(c_completed) AS c, sum(c_outcome_missing) AS om, sum(c_geometry_missing) AS gm,
  sum(c_progressive) AS pr, CASE WHEN count(n_assists)=count(*) THEN sum(n_assists) END AS n_assists,
  min(date) AS first_date, max(date) AS last_date
  FROM obs GROUP BY scope, player_id),
b AS (SELECT *, CASE WHEN families = 1 THEN fam END AS role_family,
  CASE WHEN minutes > 0 THEN round(s * 90 / minutes, 6) END AS shots_per90,
  CASE WHEN minutes > 0 AND p > 0 AND om = 0 THEN round(c / p, 6) END AS completion,
  CASE WHEN minutes > 0 AND om = 0 AND gm = 0 THEN round(pr * 90 / minutes, 6) END AS progressive_per90 FROM a),
scoped AS (SELECT *, array_to_string(list_filter([CASE WHEN r2 THEN 'card_before_entry' END, CASE WHEN r1 THEN 'invalid_roster' END,
   CASE WHEN minutes <= 0 THEN 'no_reliable_minutes' END, CASE WHEN role_family IS NULL THEN 'unknown_or_ambiguous_role' END,
   CASE WHEN withheld THEN 'unresolved_participation_conflict' END], lambda z: z IS NOT NULL), ';') AS exclusion_reasons,
 array_to_string(list_filter([CASE WHEN shots_per90 IS NULL THEN 'shots_per90' END, CASE WHEN completion IS NULL THEN 'completion' END,
   CASE WHEN progressive_per90 IS NULL THEN 'progressive_per90' END], lambda z: z IS NOT NULL), ';') AS common_unavailable FROM b)
""".replace("{obs}", OBS_SQL)
REQUIRED = ["shots_per90", "completion", "progressive_per90"]


def scoped(v, by_role_minutes=False):
    return P.scoped_profiles(
        scoped_rows(v), SCOPED_COMMON, ["n_assists"], REQUIRED, by_role_minutes
    )


@query(
    "scoped_profiles",
    "F11 F12 F15",
    SCOPED_SQL
    + """SELECT scope, player_id, minutes, appearances, role_family, first_date, last_date, shots_per90, completion, progressive_per90,
 n_assists, exclusion_reasons, common_unavailable,
 exclusion_reasons = '' AND common_unavailable = '' AND coalesce(role_family, '') <> 'GK' AS common_ready FROM scoped""",
    "pm",
)
def scoped_profiles(v):
    return scoped(v).select(
        "scope", "player_id", "minutes", "appearances", "role_family", "first_date", "last_date",
        *REQUIRED, "n_assists", F.array_join("exclusion_reasons", ";").alias("exclusion_reasons"),
        F.array_join("common_unavailable", ";").alias("common_unavailable"), "common_ready",
    )


@query(
    "scoped_role_by_minutes",
    "F11 B9",
    f"""WITH {OBS_SQL}, m AS (SELECT scope, player_id, coalesce(role_family, 'unknown') AS role_family, sum(minutes) AS m FROM obs GROUP BY ALL),
t AS (SELECT scope, player_id, sum(m) AS total FROM m GROUP BY ALL),
r AS (SELECT scope, player_id, role_family, m / total AS share,
  row_number() OVER (PARTITION BY scope, player_id ORDER BY m DESC, role_family) AS place,
  sum(m) OVER (PARTITION BY scope, player_id) / total AS known FROM m JOIN t USING (scope, player_id) WHERE role_family <> 'unknown')
SELECT t.scope, t.player_id, CASE WHEN known >= 0.6e0 AND share >= 0.4e0 THEN role_family END AS role_family
FROM t LEFT JOIN r ON r.scope=t.scope AND r.player_id=t.player_id AND place = 1""",
    "pm",
)
def scoped_role_by_minutes(v):
    return scoped(v, True).select("scope", "player_id", "role_family")


@query(
    "scope_summary",
    "F15 F21",
    SCOPED_SQL
    + """SELECT scope, count(*) AS profiles, count(*) FILTER (WHERE minutes >= 60) AS searchable,
 count(*) FILTER (WHERE exclusion_reasons <> '') AS excluded,
 count(*) FILTER (WHERE exclusion_reasons = '' AND common_unavailable = '' AND coalesce(role_family, '') <> 'GK') AS common_ready,
 min(first_date) AS first_date, max(last_date) AS last_date FROM scoped GROUP BY scope""",
    "pm",
)
def scope_summary(v):
    return P.scope_summary(scoped(v), ["scope"], 60)


@query(
    "searchable_index",
    "F21",
    SCOPED_SQL.replace(
        "SELECT scope, player_id, coalesce(sum(minutes) FILTER",
        "SELECT scope, player_id, count(DISTINCT team_id) > 1 AS multi_club, coalesce(sum(minutes) FILTER",
    )
    + """SELECT scope, player_id, 'p' AS provider, role_family, minutes,
 exclusion_reasons = '' AND common_unavailable = '' AND coalesce(role_family, '') <> 'GK' AS can_compare,
 exclusion_reasons = '' AS reliable, multi_club FROM scoped WHERE minutes >= 60""",
    "pm",
)
def searchable_index(v):
    return P.searchable_index(scoped(v), 60)


@query(
    "native_rates",
    "F13",
    """SELECT player_id, CASE WHEN passes > 0 THEN round(carries / passes, 6) END AS open_completion,
 round(sa * 90 / minutes, 6) AS key_passes_per90 FROM (
 SELECT player_id, sum(minutes) AS minutes, sum(passes) AS passes, sum(carries) AS carries,
  CASE WHEN count(shot_assists)=count(*) THEN sum(shot_assists) END AS sa FROM pm WHERE reliable GROUP BY player_id) z""",
    "pm",
)
def native_rates(v):
    totals = P.season_totals(v.pm, ["player_id"], ["passes", "carries", "shot_assists"]).select(
        "player_id",
        "minutes",
        F.col("passes").alias("open_passes"),
        F.col("carries").alias("open_completed"),
        F.lit(0.0).alias("open_outcome_missing"),
        F.col("shot_assists").alias("key_passes"),
    )
    values = P.native_values(["key_passes"], F.col("minutes"))
    return totals.select("player_id", *[c.alias(n) for n, c in values.items()])


@query(
    "feature_profiles",
    "F14 F16",
    """WITH r AS (SELECT *, CASE WHEN match_id % 41 = 0 THEN 1 ELSE 0 END AS no_pc, CASE WHEN match_id % 43 = 0 THEN 1 ELSE 0 END AS no_pp FROM pm),
a AS (SELECT player_id, bool_and(reliable) AS reliable, sum(minutes) AS minutes, count(*) AS appearances, max(no_pc) AS pc, max(no_pp) AS pp,
 sum(passes) AS passes, sum(carries) AS completed_passes, sum(progressive_passes) AS progressive_passes,
 count(DISTINCT team_id) AS teams FROM r GROUP BY player_id)
SELECT player_id, reliable, minutes, appearances, teams,
 array_to_string(list_filter([CASE WHEN pc = 1 THEN 'pass_completion' END, CASE WHEN pp = 1 THEN 'progressive_passes' END], lambda z: z IS NOT NULL), ';') AS unavailable,
 CASE WHEN reliable THEN round(passes * 90 / minutes, 6) END AS passes,
 CASE WHEN reliable THEN round(completed_passes * 90 / minutes, 6) END AS completed_passes,
 CASE WHEN reliable AND pp = 0 THEN round(progressive_passes * 90 / minutes, 6) END AS progressive_passes,
 CASE WHEN reliable AND pc = 0 AND passes > 0 THEN round(100 * completed_passes / passes, 6) END AS pass_completion FROM a""",
    "pm",
)
def feature_profiles(v):
    rows = v.pm.select(
        "player_id",
        "team_id",
        "minutes",
        "reliable",
        "passes",
        F.col("carries").alias("completed_passes"),
        "progressive_passes",
        F.array_compact(
            F.array(
                F.when(F.col("match_id") % 41 == 0, "pass_completion"),
                F.when(F.col("match_id") % 43 == 0, "progressive_passes"),
            )
        ).alias("unavailable"),
    )
    out = P.feature_profiles(rows, ["player_id"], ["passes", "completed_passes", "progressive_passes"])
    return out.select(
        "player_id", "reliable", "minutes", "appearances",
        F.size("minutes_by_team").cast("bigint").alias("teams"),
        F.array_join("unavailable", ";").alias("unavailable"),
        "passes", "completed_passes", "progressive_passes", "pass_completion",
    )


@query(
    "team_context_percentile",
    "F17 H8",
    """WITH t AS (SELECT competition_id, season, team_id, sum(minutes) AS minutes, count(*) AS matches,
  CASE WHEN count(shot_assists)=count(*) THEN sum(shot_assists) END AS sa, count(shot_assists) AS na,
  sum(passes) AS p, count(passes) AS np FROM pm GROUP BY ALL),
f AS (SELECT competition_id, season, team_id, matches, minutes, 'shot_assists_per90' AS feature, sa * 90 / minutes AS value, na AS available_matches FROM t
 UNION ALL SELECT competition_id, season, team_id, matches, minutes, 'passes_per90', p * 90 / minutes, np FROM t),
g AS (SELECT *, count(value) OVER w AS n, rank() OVER (PARTITION BY competition_id, season, feature ORDER BY value NULLS LAST) - 1 AS below,
  count(value) OVER (PARTITION BY competition_id, season, feature, value) AS same FROM f WINDOW w AS (PARTITION BY competition_id, season, feature))
SELECT competition_id, season, team_id, matches, minutes, feature, round(value, 6) AS value, available_matches,
 CASE WHEN value IS NOT NULL THEN round(100 * (below + 0.5e0 * same) / n, 6) END AS percentile FROM g""",
    "pm",
)
def team_context_percentile(v):
    out = P.team_season_context(v.pm, ["competition_id", "season"], ["shot_assists", "passes"])
    return rounded(out, "value", "percentile")


@query(
    "role_percentiles",
    "H8",
    f"""WITH l AS ({LONG_CO}), g AS (SELECT *, count(*) OVER (PARTITION BY primary_role, feature) AS n,
 rank() OVER (PARTITION BY primary_role, feature ORDER BY value) - 1 AS below,
 count(*) OVER (PARTITION BY primary_role, feature, value) AS same FROM l)
SELECT player_id, primary_role, feature, round(value, 6) AS value, round(100 * (below + 0.5e0 * same) / n, 6) AS percentile FROM g""",
    "co",
)
def role_percentiles(v):
    long = P.melt(v.co, ["player_id", "primary_role"], RATES)
    return rounded(
        with_midrank(long, ["primary_role", "feature"], "value", "percentile"), "value", "percentile"
    )


@query(
    "reference_percentiles",
    "H8",
    """SELECT p.player_id, p.primary_role, round(p.passes_per90, 6) AS value, round(100 * (
 (SELECT count(*) FROM co r WHERE r.primary_role = p.primary_role AND r.passes_per90 < p.passes_per90) + 0.5e0 *
 (SELECT count(*) FROM co r WHERE r.primary_role = p.primary_role AND r.passes_per90 = p.passes_per90))
 / (SELECT count(*) FROM co r WHERE r.primary_role = p.primary_role), 6) AS percentile
FROM pf p WHERE p.primary_role IN (SELECT primary_role FROM co)""",
    "co",
)
def reference_percentiles(v):
    reference = v.co.select("primary_role", F.col("passes_per90").alias("value"))
    probes = v.pf.select("player_id", "primary_role", F.col("passes_per90").alias("value")).join(
        reference.select("primary_role").distinct(), "primary_role", "left_semi"
    )
    return rounded(
        with_reference_midrank(probes, reference, ["primary_role"], "value", "percentile"),
        "value",
        "percentile",
    )


@query(
    "roster_depth",
    "F18",
    """SELECT club_id, coalesce(primary_role, 'unknown') AS role, count(*) FILTER (WHERE minutes > 0) AS roster_depth,
 count(*) FILTER (WHERE minutes >= 300 AND primary_role IS NOT NULL AND primary_role <> 'GK' AND shot_assists_per90 IS NOT NULL) AS profile_depth,
 sum(minutes) AS reliable_minutes, round(max(minutes) / sum(minutes), 6) AS top_player_minutes_share,
 round(sum(pow(minutes, 2)) / pow(sum(minutes), 2), 6) AS minutes_hhi FROM pf GROUP BY ALL""",
    "pf",
)
def roster_depth(v):
    eligible = F.size(P.eligibility_reasons(F.lit(300), RATES)) == 0
    members = v.pf.select(
        "club_id",
        F.coalesce("primary_role", F.lit("unknown")).alias("role"),
        "minutes",
        eligible.alias("profile_eligible"),
    )
    return rounded(
        P.roster_depth(members, ["club_id", "role"]), "top_player_minutes_share", "minutes_hhi"
    )


SPREAD = ", ".join(
    f"round(quantile_cont({{v}}, {q}), 6) AS {n}"
    for n, q in {"median": 0.5, "p25": 0.25, "p75": 0.75, "minimum": 0, "maximum": 1}.items()
)


@query(
    "roster_context",
    "F18 H8",
    f"""WITH l AS ({LONG_CO}), g AS (SELECT *, 100 * (rank() OVER (PARTITION BY primary_role, feature ORDER BY value) - 1
  + 0.5e0 * count(*) OVER (PARTITION BY primary_role, feature, value)) / count(*) OVER (PARTITION BY primary_role, feature) AS pct FROM l)
SELECT club_id, primary_role, feature, count(*) AS members, {SPREAD.format(v="pct")} FROM g GROUP BY club_id, primary_role, feature""",
    "co",
)
def roster_context(v):
    long = P.melt(v.co, ["player_id", "primary_role", "club_id"], RATES)
    scored = with_midrank(long, ["primary_role", "feature"], "value", "percentile")
    out = P.roster_spread(scored, ["club_id", "primary_role", "feature"])
    return rounded(out, "median", "p25", "p75", "minimum", "maximum")


@query(
    "club_role_distribution",
    "F19",
    f"""WITH l AS ({LONG_CO}), g AS (SELECT club_id, primary_role, feature, count(*) AS members, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75 FROM l WHERE minutes >= 90 GROUP BY ALL HAVING count(*) >= 2)
SELECT g.club_id, g.primary_role, g.feature, members, round(median, 6) AS median, round(q25, 6) AS q25, round(q75, 6) AS q75,
 round(100 * (count(*) FILTER (WHERE l.value < median - 1e-12) + 0.5e0 * count(*) FILTER (WHERE abs(l.value - median) <= 1e-12)) / count(*), 6) AS median_percentile
FROM g JOIN l ON l.primary_role = g.primary_role AND l.feature = g.feature GROUP BY ALL""",
    "co",
)
def club_role_distribution(v):
    spread = P.club_role_distribution(v.co, ["club_id", "primary_role"], RATES)
    reference = P.melt(v.co, ["primary_role"], RATES).withColumn("median", F.col("value"))
    out = with_reference_midrank(
        spread, reference, ["primary_role", "feature"], "median", "median_percentile"
    )
    return rounded(out, "median", "q25", "q75", "median_percentile")


@query(
    "role_quantiles",
    "H1 F10",
    """SELECT primary_role, round(quantile_cont(passes_per90, 0.25), 6) AS q25, round(quantile_cont(passes_per90, 0.5), 6) AS median,
 round(quantile_cont(passes_per90, 0.75), 6) AS q75 FROM co GROUP BY primary_role""",
    "co",
)
def role_quantiles(v):
    out = group_quantiles(v.co, ["primary_role"], "passes_per90", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return rounded(out, "q25", "median", "q75")


@query(
    "catalogue_counts",
    "F20 C20",
    f"""WITH {OBS_SQL} SELECT count(DISTINCT (provider, player_id)) AS players, sum(minutes) AS minutes,
 count(DISTINCT scope) AS scopes, count(*) AS rows, count(DISTINCT (provider, match_id)) AS matches FROM obs""",
    "pm",
)
def catalogue_counts(v):
    return P.catalogue_counts(scoped_rows(v))


@query(
    "merged_records",
    "F23 A6",
    """SELECT l_suppkey AS player_id, count(DISTINCT l_returnflag) AS teams, count(*) AS records,
 CAST(sum(l_linenumber) AS BIGINT) AS checksum FROM lineitem GROUP BY l_suppkey""",
)
def merged_records(v):
    rows = v.table("lineitem").select(
        F.col("l_suppkey").alias("player_id"),
        F.col("l_orderkey"),
        F.ascii("l_returnflag").alias("team_id"),
        F.col("l_returnflag").alias("team_name"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line"),
    )
    out = P.merge_records(rows, ["player_id", "order_key"], ["order_key", "line"])
    return (
        out.select(
            "player_id",
            F.explode(F.map_keys("teams")).alias("team"),
            F.size("records").alias("k"),
            F.aggregate("records", F.lit(0).cast("bigint"), lambda a, r: a + r["line"]).alias("s"),
            F.size("teams").alias("t"),
        )
        .groupBy("player_id", "team")
        .agg(F.sum(F.col("k") / F.col("t")).alias("k"), F.sum(F.col("s") / F.col("t")).alias("s"))
        .groupBy("player_id")
        .agg(
            F.count(F.lit(1)).alias("teams"),
            F.round(F.sum("k")).cast("bigint").alias("records"),
            F.round(F.sum("s")).cast("bigint").alias("checksum"),
        )
    )
