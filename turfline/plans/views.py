"""The given tables, seen as match observations.

Each view is one SELECT in the SQL both engines share; ``Views`` exposes them as
DataFrames and ``sql_prefix`` as common table expressions for the oracles.

* ``ev``: events as on-pitch actions (one match per day and squad of 22 users).
* ``lu``: line-ups, one row per match and player, with an interval on the pitch.
* ``pm``: player-match observations from orders (exposure, counts, dates, teams).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from turfline.session import settle

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

EV = """
SELECT event_id, match_id, observed_on, idx, period, clock, player_id, team_id, event_type,
  CASE WHEN event_type='Pass' AND k % 10 = 0 THEN 'Corner'
       WHEN event_type='Pass' AND k % 10 = 1 THEN 'Free Kick'
       WHEN event_type='Shot' AND k % 8 = 0 THEN 'Penalty'
       WHEN event_type='Shot' THEN 'Open Play'
       WHEN event_type='Duel' AND k % 8 < 4 THEN 'Tackle' END AS subtype,
  CASE WHEN event_type='Pass' AND k % 5 = 2 THEN 'Incomplete'
       WHEN event_type='Pass' THEN 'Complete'
       WHEN event_type='Shot' AND k % 6 = 1 THEN 'Goal'
       WHEN event_type='Shot' THEN 'Saved' END AS outcome,
  CASE WHEN v % 241 = 0 THEN NULL ELSE CAST(v * 7 % 1050 AS DOUBLE) / 10 END AS x,
  CASE WHEN v % 241 = 0 THEN NULL ELSE CAST(v * 13 % 680 AS DOUBLE) / 10 END AS y,
  CASE WHEN event_type IN ('Pass','Carry') AND v % 239 <> 0
       THEN CAST((v * 7 + k * 29) % 1050 AS DOUBLE) / 10 END AS end_x,
  CASE WHEN event_type IN ('Pass','Carry') AND v % 239 <> 0
       THEN CAST((v * 13 + k * 17) % 680 AS DOUBLE) / 10 END AS end_y,
  CASE WHEN event_type='Shot' AND v % 97 <> 0 THEN CAST(v % 97 AS DOUBLE) / 100 END AS xg,
  CASE WHEN v % 311 <> 0 THEN spell END AS possession,
  squad * 2 + spell % 2 AS possession_team,
  k % 9 = 0 AS is_cross, k % 3 = 0 AS counterpress, v, k
FROM (
  SELECT event_id, dom * 1000000 + squad AS match_id, observed_on, event_id AS idx,
    CASE WHEN h < 11 THEN 1 WHEN h < 22 THEN 2 ELSE 5 END AS period,
    CAST((h - CASE WHEN h < 11 THEN 0 WHEN h < 22 THEN 11 ELSE 22 END) * 3600 + mi * 60 + s
         AS DOUBLE) / 14 AS clock,
    user_id AS player_id, CAST(floor(user_id / 11e0) AS BIGINT) AS team_id,
    CASE WHEN event_type='click' THEN 'Pass' WHEN event_type='view' THEN 'Carry'
         WHEN event_type='purchase' THEN 'Shot' WHEN event_type='error' THEN 'Pressure'
         WHEN k % 4 = 0 THEN 'Duel' WHEN k % 4 = 1 THEN 'Interception'
         WHEN k % 4 = 2 THEN 'Ball Recovery' ELSE 'Dribble' END AS event_type,
    CAST(h * 6 + floor(mi / 10e0) AS BIGINT) AS spell, v, k, squad
  FROM (
    SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS observed_on,
      CAST(dayofmonth(ts) AS BIGINT) AS dom, CAST(hour(ts) AS BIGINT) AS h,
      CAST(minute(ts) AS BIGINT) AS mi, CAST(floor(second(ts)) AS BIGINT) AS s,
      CAST(floor(user_id / 22e0) AS BIGINT) AS squad,
      CAST(round(value * 100) AS BIGINT) AS v, CAST({json_k} AS BIGINT) AS k
    FROM {events}
  ) raw
) timed
"""

LU = """
SELECT match_id, player_id, team_id, observed_on,
  CASE WHEN player_id % 11 >= 9 THEN 1500e0 ELSE 0e0 END AS start_s,
  CASE WHEN player_id % 11 = 8 THEN 3000e0 ELSE 5658e0 END AS end_s,
  CASE WHEN (player_id + match_id) % 19 = 0 THEN NULL
       ELSE (CASE WHEN player_id % 11 = 8 THEN 3000e0 ELSE 5658e0 END
             - CASE WHEN player_id % 11 >= 9 THEN 1500e0 ELSE 0e0 END) / 60 END AS minutes,
  (player_id + match_id) % 19 <> 0 AS reliable,
  player_id % 11 < 9 AS starter,
  CASE WHEN player_id % 7 = 0 THEN 'native' ELSE 'statsbomb' END AS provider
FROM (SELECT DISTINCT match_id, player_id, team_id, observed_on FROM {ev}) roster
"""

PM = """
SELECT player_id, match_id, observed_on, season, competition_id, club_id, role,
  CAST((player_id * 7 + CAST(floor((mo + season * 12) / 9e0) AS BIGINT) * 3) % 40 AS BIGINT)
    AS team_id,
  CAST(t % 90 + 1 AS DOUBLE) AS minutes, match_id % 37 <> 0 AS reliable,
  CAST(t % 7 + player_id % 3 AS DOUBLE) AS shots,
  CAST(t % 3 + player_id % 2 AS DOUBLE) AS box_shots,
  CAST(CASE WHEN match_id % 499 = 0 THEN NULL
       ELSE floor(t / 7e0) % 5 + player_id % 4 END AS DOUBLE) AS shot_assists,
  CAST(floor(t / 11e0) % 60 + player_id % 30 AS DOUBLE) AS passes,
  CAST(floor(t / 13e0) % 12 + player_id % 7 AS DOUBLE) AS progressive_passes,
  CAST(floor(t / 17e0) % 40 + player_id % 19 AS DOUBLE) AS carries,
  CAST(floor(t / 19e0) % 6 + player_id % 5 AS DOUBLE) AS tackles,
  CAST(floor(t / 29e0) % 20 + player_id % 11 AS DOUBLE) AS pressures,
  CAST(floor(t / 31e0) % 90 + 30 AS DOUBLE) AS own_possessions,
  CAST(floor(t / 37e0) % 90 + 30 AS DOUBLE) AS opponent_possessions
FROM (
  SELECT o_custkey AS player_id, o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS observed_on,
    CAST(year(o_orderdate) AS BIGINT) AS season, CAST(month(o_orderdate) AS BIGINT) AS mo,
    o_custkey % 3 AS competition_id, CAST(c_nationkey AS BIGINT) AS club_id,
    CAST(floor(o_totalprice) AS BIGINT) AS t,
    CASE WHEN o_orderkey % 11 = 0 THEN 'unknown'
         WHEN (o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) % 6 = 0 THEN 'CB'
         WHEN (o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) % 6 = 1 THEN 'FB/WB'
         WHEN (o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) % 6 = 2 THEN 'CM'
         WHEN (o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) % 6 = 3 THEN 'W'
         WHEN (o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) % 6 = 4 THEN 'ST'
         ELSE 'GK' END AS role
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey
) base
"""

# The counts of ``pm`` and their families.
PM_FAMILIES = {
    "shots": "shooting",
    "box_shots": "shooting",
    "shot_assists": "creation",
    "passes": "passing",
    "progressive_passes": "passing",
    "carries": "carrying",
    "tackles": "defending",
    "pressures": "defending",
}
PM_COUNTS = list(PM_FAMILIES)

# Season profiles in SQL, for the oracles of everything downstream of profiles.
_TOTALS = ",\n  ".join(
    f"CASE WHEN count({c}) = count(*) THEN sum({c}) END AS {c}" for c in PM_COUNTS
)
_RATES = ",\n  ".join(f"{c} * 90e0 / minutes AS {c}_per90" for c in PM_COUNTS)
PF = f"""
SELECT a.player_id, a.minutes, a.competition_id, a.club_id, a.appearances, r.primary_role,
  {_RATES}
FROM (
  SELECT player_id, min(competition_id) AS competition_id, min(club_id) AS club_id,
    sum(minutes) AS minutes, count(*) AS appearances,
  {_TOTALS}
  FROM {{pm}} WHERE reliable GROUP BY player_id
) a LEFT JOIN (
  SELECT player_id, CASE WHEN known >= 0.6e0 AND share >= 0.4e0 THEN role END AS primary_role FROM (
    SELECT player_id, role, m / total AS share, sum(m) OVER (PARTITION BY player_id) / total AS known,
      row_number() OVER (PARTITION BY player_id ORDER BY m DESC, role) AS place
    FROM (SELECT player_id, role, sum(minutes) AS m FROM {{pm}}
          WHERE reliable AND role <> 'unknown' GROUP BY player_id, role) x
    JOIN (SELECT player_id, sum(minutes) AS total FROM {{pm}} WHERE reliable GROUP BY player_id) y
    USING (player_id)
  ) z WHERE place = 1
) r ON a.player_id = r.player_id
"""

# Comparison cohort: eligible profiles of roles with at least twelve of them.
CO = """
SELECT * FROM (
  SELECT *, count(*) OVER (PARTITION BY primary_role) AS role_size FROM {pf}
  WHERE minutes >= 300 AND primary_role IS NOT NULL AND primary_role <> 'GK'
    AND shot_assists_per90 IS NOT NULL
) e WHERE role_size >= 12
"""

DERIVED = {"ev": EV, "lu": LU, "pm": PM, "pf": PF, "co": CO}
NEEDS = {"ev": [], "lu": ["ev"], "pm": [], "pf": ["pm"], "co": ["pf"]}
JSON_K = {"spark": "get_json_object(props, '$.k')", "duckdb": "json_extract_string(props, '$.k')"}


def sql_prefix(names: list[str], sql: str) -> str:
    """Oracle text: the named derived views as CTEs in front of ``sql``."""
    ordered: list[str] = []

    def add(name: str):
        for need in NEEDS[name]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    plain = {t: t for t in [*TABLES, *DERIVED]}
    parts = [f"{n} AS ({DERIVED[n].format(json_k=JSON_K['duckdb'], **plain)})" for n in ordered]
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


class Views:
    """Tables of one folder and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text.format(json_k=JSON_K["spark"], **{k: "{%s}" % k for k in frames}), **frames)

    @cached_property
    def ev(self) -> DataFrame:
        return self.sql(EV, events=self.table("events"))

    @cached_property
    def lu(self) -> DataFrame:
        return self.sql(LU, ev=self.ev)

    @cached_property
    def pm(self) -> DataFrame:
        return self.sql(PM, orders=self.table("orders"), customer=self.table("customer"))

    @cached_property
    def pf(self) -> DataFrame:
        from turfline.operators.profiles import season_profiles

        return season_profiles(
            self.pm, ["player_id"], PM_COUNTS, carry=["competition_id", "club_id"]
        )

    @cached_property
    def co(self) -> DataFrame:
        from turfline.operators.profiles import comparison_cohort

        rows = comparison_cohort(
            self.pf, ["player_id"], 300, [f"{c}_per90" for c in PM_COUNTS]
        )
        # Mart-level cut: profiles are read many times downstream, computed once.
        return settle(rows, "cohort")
