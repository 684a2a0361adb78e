"""Split, stint and transition queries: G1-G13."""

from __future__ import annotations

from pyspark.sql import functions as F

from turfline.operators import profiles as P
from turfline.operators import timesplit as G
from turfline.plans.registry import query
from turfline.plans.views import PM_COUNTS

CUT = """cut AS (SELECT d AS cutoff FROM (SELECT observed_on AS d, row_number() OVER (ORDER BY observed_on, match_id) - 1 AS i,
  count(*) OVER () AS n FROM pm) z WHERE i = floor(n / 2))"""
RATES = [f"{c}_per90" for c in PM_COUNTS]
HALF_TOTALS = ", ".join(f"CASE WHEN count({c})=count(*) THEN sum({c}) END * 90e0 / sum(minutes) AS {c}_per90" for c in PM_COUNTS)


@query(
    "median_split",
    "G1",
    f"""WITH {CUT} SELECT player_id, CASE WHEN observed_on < cutoff THEN 'first' ELSE 'second' END AS "window",
 count(*) AS matches, sum(minutes) AS minutes FROM pm, cut GROUP BY ALL""",
    "pm",
)
def median_split(v):
    return G.median_split(v.pm).groupBy("player_id", "window").agg(
        F.count(F.lit(1)).alias("matches"), F.sum("minutes").alias("minutes")
    )


HALVES_SQL = f"""{CUT}, lab AS (SELECT pm.*, CASE WHEN observed_on < cutoff THEN 'first' ELSE 'second' END AS win FROM pm, cut WHERE reliable),
tt AS (SELECT player_id, win, sum(minutes) AS total FROM lab GROUP BY ALL),
rr AS (SELECT player_id, win, role, share, known FROM (SELECT player_id, win, role, m / total AS share,
    sum(m) OVER (PARTITION BY player_id, win) / total AS known,
    row_number() OVER (PARTITION BY player_id, win ORDER BY m DESC, role) AS place
  FROM (SELECT player_id, win, role, sum(minutes) AS m FROM lab WHERE role <> 'unknown' GROUP BY ALL) x JOIN tt USING (player_id, win)) y WHERE place = 1),
vv AS (SELECT player_id, win, sum(minutes) AS minutes, {HALF_TOTALS} FROM lab GROUP BY ALL),
halves AS (SELECT vv.*, CASE WHEN known >= 0.6e0 AND share >= 0.4e0 THEN role END AS primary_role FROM vv LEFT JOIN rr USING (player_id, win)),
paired AS (SELECT player_id, count(*) AS windows,
  bool_or(minutes < 100 OR primary_role IS NULL OR primary_role = 'GK' OR shot_assists_per90 IS NULL) AS bad,
  max(CASE WHEN win = 'first' THEN primary_role END) AS role_first, max(CASE WHEN win = 'second' THEN primary_role END) AS role_second
  FROM halves GROUP BY player_id),
excl AS (SELECT player_id, role_first, role_second, CASE WHEN windows < 2 THEN 'absent_window' WHEN bad THEN 'window_eligibility'
  WHEN role_first <> role_second THEN 'role_change' END AS exclusion FROM paired)"""


def halves(v):
    """Season profiles of both windows."""
    return P.season_profiles(G.median_split(v.pm), ["player_id", "window"], PM_COUNTS)


def window_pairs(v, rows=None):
    return G.window_exclusions(
        rows if rows is not None else halves(v), "player_id", 200,
        P.eligibility_reasons(F.lit(100), RATES),
    )


@query(
    "window_exclusions",
    "G1 F8",
    f"WITH {HALVES_SQL} SELECT player_id, role_first, role_second, exclusion FROM excl",
    "pm",
)
def window_exclusions(v):
    return window_pairs(v)


@query(
    "scoped_match_split",
    "G2",
    """SELECT competition_id, season, match_id, CASE WHEN i <= floor(n / 2) THEN 'first' ELSE 'second' END AS half FROM (
 SELECT competition_id, season, match_id, row_number() OVER (PARTITION BY competition_id, season ORDER BY observed_on, match_id) AS i,
 count(*) OVER (PARTITION BY competition_id, season) AS n FROM pm) z""",
    "pm",
)
def scoped_match_split(v):
    return G.scoped_match_split(v.pm, ["competition_id", "season"])


@query(
    "alternating_split",
    "G3",
    """SELECT player_id, match_id, CAST((row_number() OVER (PARTITION BY player_id ORDER BY observed_on, match_id) - 1) % 2 AS INT) AS half FROM pm""",
    "pm",
)
def alternating_split(v):
    rows = v.pm.select("player_id", "match_id", "observed_on")
    out = G.alternating_split(
        rows, ["player_id"], ["observed_on", "match_id"], G.month_of("observed_on")
    )
    return out.select("player_id", "match_id", "half")


FOLD = "(" + " + ".join(
    f"CAST('0x' || substr(sha256({{k}}), {i}, 1) AS BIGINT)" for i in range(1, 65)
) + ") % 5"


@query(
    "hash_fold",
    "G4",
    "SELECT c_custkey, " + FOLD.format(k="'seed:' || CAST(c_custkey AS VARCHAR)") + " AS fold FROM customer",
)
def hash_fold(v):
    return G.hash_folds(v.table("customer").select("c_custkey"), "c_custkey", 5, "seed:")


@query(
    "trailing_context",
    "G6",
    """WITH d AS (SELECT club_id, observed_on, count(*) AS n, sum(minutes) AS minutes, sum(passes) AS passes, sum(shots) AS shots FROM pm GROUP BY ALL)
SELECT p.match_id, p.club_id, p.observed_on AS cutoff, CASE WHEN sum(n) >= 3 THEN CAST(sum(n) AS BIGINT) END AS matches,
 CASE WHEN sum(n) >= 3 THEN min(d.observed_on) END AS first_date, CASE WHEN sum(n) >= 3 THEN max(d.observed_on) END AS last_date,
 CASE WHEN sum(n) >= 3 THEN round(90 * sum(d.passes) / sum(d.minutes), 6) END AS passes_per90,
 CASE WHEN sum(n) >= 3 THEN round(90 * sum(d.shots) / sum(d.minutes), 6) END AS shots_per90
FROM pm p JOIN d ON d.club_id = p.club_id AND d.observed_on BETWEEN p.observed_on - 365 AND p.observed_on
GROUP BY p.match_id, p.club_id, p.observed_on""",
    "pm",
)
def trailing_context(v):
    probes = v.pm.select("match_id", "club_id", F.col("observed_on").alias("cutoff"))
    out = G.trailing_context(
        v.pm, probes, "club_id", "observed_on", "cutoff", ["minutes", "passes", "shots"]
    )
    return out.select(
        "match_id", "club_id", "cutoff", "matches", "first_date", "last_date",
        F.round(90 * F.col("passes") / F.col("minutes"), 6).alias("passes_per90"),
        F.round(90 * F.col("shots") / F.col("minutes"), 6).alias("shots_per90"),
    )


STINT_SQL = """st AS (SELECT *, sum(chg) OVER (PARTITION BY player_id ORDER BY observed_on, match_id) AS stint FROM (
  SELECT *, CASE WHEN lag(team_id) OVER w IS NULL OR lag(team_id) OVER w <> team_id THEN 1 ELSE 0 END AS chg FROM pm
  WINDOW w AS (PARTITION BY player_id ORDER BY observed_on, match_id)) x)"""
ENV_SQL = f"""{STINT_SQL},
env AS (SELECT player_id, CAST(stint AS BIGINT) AS stint, player_id * 1000 + CAST(stint AS BIGINT) AS environment_id, min(team_id) AS team_id,
  min(team_id) % 4 AS competition_id, min(observed_on) AS start_date, max(observed_on) AS end_date, count(*) AS appearances,
  coalesce(sum(minutes) FILTER (WHERE reliable), 0) AS minutes, bool_and(reliable) AS reliable, min(season) AS season, min(club_id) AS club_id,
  min(role) AS role,
  CASE WHEN count(*) FILTER (WHERE reliable) > 0 AND count(shot_assists) FILTER (WHERE reliable) = count(*) FILTER (WHERE reliable)
   THEN sum(shot_assists) FILTER (WHERE reliable) END AS shot_assists,
  CASE WHEN count(*) FILTER (WHERE reliable) > 0 THEN sum(passes) FILTER (WHERE reliable) END AS passes
 FROM st GROUP BY player_id, stint)"""


def numbered(v):
    return G.stints(
        v.pm, ["player_id"], "team_id", ["observed_on", "match_id"], G.month_of("observed_on")
    )


def env(v):
    rows = G.environments(
        numbered(v), ["player_id"], "team_id", ["shot_assists", "passes"], ["season", "club_id", "role"]
    )
    return rows.withColumns(
        {
            "stint": F.col("stint").cast("bigint"),
            "environment_id": (F.col("player_id") * 1000 + F.col("stint")).cast("bigint"),
            "competition_id": F.col("team_id") % 4,
        }
    )


@query(
    "stints",
    "G7",
    f"WITH {STINT_SQL} SELECT player_id, match_id, team_id, CAST(stint AS BIGINT) AS stint FROM st",
    "pm",
)
def stints(v):
    return numbered(v).select("player_id", "match_id", "team_id", F.col("stint").cast("bigint").alias("stint"))


@query(
    "environments",
    "G10 E6",
    f"""WITH {ENV_SQL} SELECT player_id, stint, environment_id, team_id, competition_id, start_date, end_date, appearances, minutes,
 reliable, season, club_id, role, shot_assists, passes FROM env""",
    "pm",
)
def environments(v):
    return env(v)


ADJ = "('CB|FB/WB','CB|DM','CM|DM','AM|CM','AM|W','ST|W','FB/WB|W')"
TRANS_SQL = f"""{ENV_SQL},
nx AS (SELECT e.*, lead(environment_id) OVER w AS n_id, lead(team_id) OVER w AS n_team, lead(competition_id) OVER w AS n_comp,
  lead(season) OVER w AS n_season, lead(start_date) OVER w AS n_start, lead(role) OVER w AS n_role, lead(minutes) OVER w AS n_minutes,
  lead(passes) OVER w AS n_passes
  FROM env e WINDOW w AS (PARTITION BY player_id ORDER BY start_date, end_date, environment_id)),
tr AS (SELECT player_id, environment_id AS source_environment_id, n_id AS destination_environment_id, end_date AS source_end, n_start AS destination_start,
  datediff('day', end_date, n_start) AS gap_days,
  CASE WHEN team_id <> n_team AND competition_id <> n_comp THEN 'cross_league_change' WHEN competition_id <> n_comp THEN 'competition_context_change'
   WHEN team_id <> n_team AND season = n_season THEN 'same_league_team_change' WHEN team_id <> n_team THEN 'team_and_season_change'
   ELSE 'season_change_same_team' END AS transition_type,
  competition_id AS source_competition, n_comp AS destination_competition, season AS source_season, n_season AS destination_season,
  minutes AS source_minutes, n_minutes AS destination_minutes, passes AS source_passes, n_passes AS destination_passes,
  role AS source_role, n_role AS destination_role,
  CASE WHEN role = n_role THEN 'same' WHEN least(role, n_role) || '|' || greatest(role, n_role) IN {ADJ} THEN 'adjacent' ELSE 'major' END AS role_change,
  list_filter([CASE WHEN datediff('day', end_date, n_start) <= 0 THEN 'overlapping_observations' END,
   CASE WHEN datediff('day', end_date, n_start) > 100 THEN 'observation_gap_over_100_days' END,
   CASE WHEN n_season - season > 1 THEN 'unobserved_intervening_season' END,
   CASE WHEN player_id % 50 = 0 THEN 'rejected_identity' END,
   CASE WHEN team_id = n_team AND competition_id = n_comp AND season = n_season THEN 'same_environment' END], lambda z: z IS NOT NULL) AS reasons
 FROM nx WHERE n_id IS NOT NULL)"""


def transitions_of(v, rows=None):
    rows = (rows if rows is not None else env(v)).withColumns(
        {
            "season_id": F.col("season"),
            "season_start_year": F.col("season"),
            "country": F.col("club_id"),
            "quarantined": F.col("player_id") % 50 == 0,
        }
    )
    return G.adjacent_transitions(rows, ["player_id"], 100)


@query(
    "transitions",
    "G8 G9",
    f"""WITH {TRANS_SQL} SELECT player_id, source_environment_id, destination_environment_id, source_end, destination_start,
 CAST(gap_days AS INT) AS gap_days, transition_type, role_change, array_to_string(reasons, ';') AS exclusion_reasons, len(reasons) = 0 AS structurally_eligible FROM tr""",
    "pm",
)
def transitions(v):
    return transitions_of(v).select(
        "player_id", "source_environment_id", "destination_environment_id", "source_end", "destination_start",
        "gap_days", "transition_type", "role_change",
        F.array_join("exclusion_reasons", ";").alias("exclusion_reasons"), "structurally_eligible",
    )


def episodes(v):
    """Transitions with exposure and passes of both sides."""
    from turfline.session import settle

    rows = settle(env(v), "environments")
    side = lambda p: rows.select(
        F.col("environment_id").alias(f"{p}_environment_id"),
        F.col("minutes").alias(f"{p}_minutes"),
        F.col("passes").alias(f"{p}_passes"),
        F.col("role").alias(f"{p}_role"),
        F.col("season").alias(f"{p}_season"),
        F.col("team_id").alias(f"{p}_team_id"),
    )
    return (
        transitions_of(v, rows)
        .join(side("source"), "source_environment_id")
        .join(side("destination"), "destination_environment_id")
    )


ELIG_SQL = f"""{TRANS_SQL}, el AS (SELECT *, list_concat(reasons, list_filter([CASE WHEN source_minutes < threshold THEN 'source_below_minutes' END,
  CASE WHEN destination_minutes < threshold THEN 'destination_below_minutes' END], lambda z: z IS NOT NULL)) AS why
  FROM tr, (VALUES (30e0), (60e0)) h(threshold))"""


@query(
    "transition_eligibility",
    "G11",
    f"WITH {ELIG_SQL} SELECT threshold, reason, count(*) AS n FROM (SELECT threshold, unnest(why) AS reason FROM el) z GROUP BY ALL",
    "pm",
)
def transition_eligibility(v):
    return P.reason_histogram(G.transition_eligibility(episodes(v), [30, 60]), ["threshold"])


@query(
    "evidence_matrix",
    "G12",
    f"""WITH {ELIG_SQL} SELECT threshold, source_competition, destination_competition, count(*) AS episodes, count(DISTINCT player_id) AS players
FROM el WHERE len(why) = 0 GROUP BY ALL""",
    "pm",
)
def evidence_matrix(v):
    return G.evidence_matrix(G.transition_eligibility(episodes(v), [30, 60]))


@query(
    "episode_split",
    "G5 G4",
    f"""WITH {TRANS_SQL} SELECT CASE WHEN destination_season >= 2000 THEN 'test' WHEN {FOLD.format(k="'p:' || CAST(player_id AS VARCHAR)")} = 0 THEN 'validation' ELSE 'train' END AS part,
 count(*) AS episodes, count(DISTINCT player_id) AS players FROM tr WHERE len(reasons) = 0 GROUP BY ALL""",
    "pm",
)
def episode_split(v):
    rows = G.episode_split(episodes(v).where("structurally_eligible"), 2000, "p:")
    per_player = rows.groupBy("part", "player_id").agg(F.count(F.lit(1)).alias("e"))
    return per_player.groupBy("part").agg(
        F.sum("e").alias("episodes"), F.count(F.lit(1)).alias("players")
    )


# The last season of the feed carries features of an older version.
VERSION_SQL = "CASE WHEN {s} >= 2001 THEN 'features-v0' ELSE 'features-v1' END"
VERSION_PART = f"""{TRANS_SQL}, vs AS (SELECT *, {VERSION_SQL.format(s="source_season")} AS sv, {VERSION_SQL.format(s="destination_season")} AS dv,
  CASE WHEN destination_season >= 2000 THEN 'test' WHEN {FOLD.format(k="'p:' || CAST(player_id AS VARCHAR)")} = 0 THEN 'validation' ELSE 'train' END AS part FROM tr WHERE len(reasons) = 0)"""


def versioned(v):
    version = lambda c: F.when(F.col(c) >= 2001, "features-v0").otherwise("features-v1")
    rows = episodes(v).where("structurally_eligible").withColumns(
        {f"{p}_version": version(f"{p}_season") for p in ("source", "destination")}
    )
    return G.episode_split(rows, 2000, "p:")


@query(
    "split_leaks",
    "G5",
    f"""WITH {VERSION_PART} SELECT count(*) FILTER (WHERE source_end >= destination_start) AS overlapping_dates,
 count(*) FILTER (WHERE sv <> 'features-v1' OR dv <> 'features-v1') AS mixed_versions,
 (SELECT count(*) FROM (SELECT player_id FROM vs WHERE part <> 'test' GROUP BY player_id HAVING count(DISTINCT part) > 1) q) AS shared_players FROM vs""",
    "pm",
)
def split_leaks(v):
    return G.split_leaks(versioned(v), "features-v1")


@query(
    "checked_episodes",
    "G5",
    f"""WITH {VERSION_PART}, j AS (SELECT *, array_to_string(list_filter([CASE WHEN sv <> 'features-v1' OR dv <> 'features-v1' THEN 'feature_version' END,
  CASE WHEN source_end >= destination_start THEN 'overlapping_dates' END], lambda z: z IS NOT NULL), ';') AS broken FROM vs)
SELECT source_season, destination_season, part, broken, count(*) AS episodes, count(DISTINCT player_id) AS players FROM j GROUP BY ALL""",
    "pm",
)
def checked_episodes(v):
    """Season pairs of the parts with the assertions their episodes break."""
    rows = G.leakage_checked(versioned(v), "features-v1").withColumn("broken", F.array_join("broken", ";"))
    keys = ["source_season", "destination_season", "part", "broken"]
    per_player = rows.groupBy(*keys, "player_id").agg(F.count(F.lit(1)).alias("e"))
    return per_player.groupBy(*keys).agg(F.sum("e").alias("episodes"), F.count(F.lit(1)).alias("players"))


@query(
    "digest_partition",
    "G13",
    """SELECT n_nationkey, CASE WHEN row_number() OVER (ORDER BY sha256('q:' || CAST(n_nationkey AS VARCHAR))) <= 8 THEN 'development' ELSE 'final' END AS part FROM nation""",
)
def digest_partition(v):
    return G.digest_partition(v.table("nation"), "n_nationkey", 8, "q:")
