"""Interval queries: D1-D9, B2, B3."""

from __future__ import annotations

from pyspark.sql import functions as F

from turfline.functions.text import clock_seconds
from turfline.operators import counting as C
from turfline.operators import intervals as I
from turfline.operators.periods import period_ends
from turfline.plans.registry import query
from turfline.session import settle

ENDS = """ends AS (SELECT match_id, period, length, coalesce(sum(length) OVER (PARTITION BY match_id ORDER BY period
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS "offset" FROM (
  SELECT match_id, period, max(clock) AS length FROM ev WHERE period < 5 GROUP BY ALL) p)"""


@query(
    "period_ends",
    "B2 B3",
    f"""WITH {ENDS} SELECT match_id, period, round(length, 6) AS length, round("offset", 6) AS "offset" FROM ends""",
    "ev",
)
def period_ends_query(v):
    # The clock goes through its text form and back (B2).
    total = F.round(F.col("clock") * 1000).cast("bigint")
    text = F.format_string(
        "%02d:%02d:%02d.%03d",
        F.floor(total / 3600000),
        F.floor(total / 60000) % 60,
        F.floor(total / 1000) % 60,
        total % 1000,
    )
    checked = v.ev.withColumn("text", text).withColumn(
        "clock", F.when(F.abs(clock_seconds("text") - F.col("clock")) < 0.001, F.col("clock"))
    )
    out = period_ends(checked)
    return out.withColumns({c: F.round(c, 6) for c in ("length", "offset")})


# Boundary rows built from the units of the events: eleven starters and three
# substitutes per team, one substitution chain, one off/on pair, one shift, cards.
UNITS = f"""{ENDS}, units AS (SELECT u.match_id, u.team_id, e1.length AS l1, e2.length AS l2 FROM (
  SELECT DISTINCT match_id, team_id FROM ev) u
  JOIN ends e1 ON e1.match_id = u.match_id AND e1.period = 1 JOIN ends e2 ON e2.match_id = u.match_id AND e2.period = 2)"""
SLOTS = "(VALUES " + ", ".join(f"({s})" for s in range(14)) + ") t(slot)"
PART_SQL = f"""
WITH {UNITS},
r AS (SELECT match_id, team_id, slot, l1, l2, l1 + l2 AS duration,
   CASE WHEN slot < 11 THEN team_id * 11 + slot ELSE 1000000 + team_id * 3 + slot - 11 END AS player_id,
   l1 + floor(l2 * 0.5e0) AS s1, l1 + floor(l2 * 0.7e0) AS s2, l1 + floor(l2 * 0.6e0) AS red FROM units, {SLOTS}),
g AS (
  SELECT *, 0e0 AS a, CASE WHEN slot = 10 THEN s1 WHEN slot = 5 AND match_id % 3 = 0 THEN red WHEN slot = 3 THEN 600e0
     WHEN slot = 7 THEN 1500e0 ELSE duration END AS b,
     CASE WHEN slot = 0 THEN 'GK' WHEN slot < 5 THEN 'CB' WHEN slot < 8 THEN 'CM' ELSE 'ST' END AS role FROM r WHERE slot < 11
  UNION ALL SELECT *, 720e0, duration, 'unknown' FROM r WHERE slot = 3
  UNION ALL SELECT *, 1500e0, duration, 'W' FROM r WHERE slot = 7
  UNION ALL SELECT *, s1, s2, 'ST' FROM r WHERE slot = 11
  UNION ALL SELECT *, s2, duration, 'ST' FROM r WHERE slot = 12)"""
PART_TAIL = """,
acts AS (SELECT e.match_id, e.player_id, e.clock + o."offset" AS at FROM ev e JOIN ends o USING (match_id, period)),
bad AS (SELECT DISTINCT a.match_id, a.player_id FROM acts a WHERE NOT EXISTS (SELECT 1 FROM g
   WHERE g.match_id = a.match_id AND g.player_id = a.player_id AND a.at BETWEEN g.a - 2 AND g.b + 2))
"""


def match_sheets(v):
    """(events, tactics, roster, positions, ends) in the shape ``reconstruct`` reads."""
    ends = period_ends(v.ev)
    length = ends.groupBy("match_id").agg(
        F.max(F.when(F.col("period") == 1, F.col("length"))).alias("l1"),
        F.max(F.when(F.col("period") == 2, F.col("length"))).alias("l2"),
    )
    units = v.ev.select("match_id", "team_id").distinct().join(
        length.where(F.col("l1").isNotNull() & F.col("l2").isNotNull()), "match_id"
    )
    units = settle(units, "units")
    uid = F.col("match_id") * 1000000 + F.col("team_id") * 10
    none, boolean = F.lit(None).cast("bigint"), F.lit(None).cast("boolean")

    at = lambda share: F.floor(F.col("l2") * share)
    slot = lambda s: F.col("team_id") * 11 + s
    bench = lambda s: F.lit(1000000) + F.col("team_id") * 3 + s
    third = F.col("match_id") % 3 == 0

    def mark(kind, code, period, clock, player=none, replacement=none, card=None):
        return F.struct(
            (uid + code).alias("event_id"),
            F.lit(-10 + code).cast("bigint").alias("idx"),
            F.lit(period).cast("bigint").alias("period"),
            clock.cast("double").alias("clock"),
            F.lit(kind).alias("event_type"),
            player.cast("bigint").alias("player_id"),
            F.lit(card).cast("string").alias("card"),
            replacement.cast("bigint").alias("replacement_id"),
        )

    marks = [
        mark("Starting XI", 0, 1, F.lit(0)),
        mark("Tactical Shift", 1, 1, F.lit(1500)),
        mark("Player Off", 2, 1, F.lit(600), slot(3)),
        mark("Player On", 3, 1, F.lit(720), slot(3)),
        mark("Substitution", 4, 2, at(0.5), slot(10), bench(0)),
        F.when(third, mark("Bad Behaviour", 5, 2, at(0.6), slot(5), card="Red Card")),
        mark("Substitution", 6, 2, at(0.7), bench(0), bench(1)),
    ]
    made = units.select(
        "match_id", "team_id", F.explode(F.array_compact(F.array(*marks))).alias("m")
    ).select("match_id", "team_id", "m.*", boolean.alias("permanent"))
    played = v.ev.select(
        "match_id", "event_id", "idx", "period", "clock", "event_type", "player_id", "team_id",
        F.lit(None).cast("string").alias("card"), none.alias("replacement_id"), boolean.alias("permanent"),
    )
    events = played.unionByName(made)
    place = F.col("slot")
    role = F.when(place == 0, "GK").when(place < 5, "CB").when(place < 8, "CM").otherwise("ST")
    sheet = units.select("match_id", "team_id", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("slot"))
    listed = sheet.select(uid.alias("event_id"), slot(F.col("slot")).alias("player_id"), role.alias("role"))
    moved = units.select((uid + 1).alias("event_id"), slot(7).alias("player_id"), F.lit("W").alias("role"))
    roster = sheet.select("match_id", "team_id", slot(F.col("slot")).alias("player_id")).unionByName(
        units.select(
            "match_id", "team_id", F.explode(F.array(bench(0), bench(1), bench(2))).alias("player_id")
        )
    )
    positions = units.select(
        "match_id",
        slot(0).alias("player_id"),
        F.lit(0).alias("place"),
        F.lit("GK").alias("role"),
        F.lit(1).cast("bigint").alias("from_period"),
        F.lit(0.0).alias("from_clock"),
        F.lit(None).cast("bigint").alias("to_period"),
        F.lit(None).cast("double").alias("to_clock"),
    )
    return events, listed.unionByName(moved), roster, positions, ends


@query(
    "participation_segments",
    "D2 D4",
    PART_SQL + " SELECT match_id, player_id, round(a, 6) AS start_s, round(b, 6) AS end_s, role FROM g",
    "ev",
)
def participation_segments(v):
    """What the sheets state, also where a match's events end before a stated boundary."""
    segments, _ = I.reconstruct(*match_sheets(v), stated=True)
    return segments.withColumns({c: F.round(c, 6) for c in ("start_s", "end_s")})


@query(
    "participation_minutes",
    "D2 D3 D5 D6",
    PART_SQL
    + PART_TAIL
    + """, t AS (SELECT match_id, player_id, sum(b - a) / 60 AS m FROM g GROUP BY ALL)
SELECT r.match_id, r.team_id, r.player_id, CASE WHEN bad.player_id IS NULL THEN round(coalesce(m, 0), 6) END AS minutes,
 bad.player_id IS NULL AS reliable,
 CASE WHEN bad.player_id IS NOT NULL THEN 'conflicting' WHEN slot IN (0, 13) THEN 'reliable' ELSE 'reconciled' END AS quality,
 CASE WHEN bad.player_id IS NULL THEN '' ELSE 'action_outside_participation' END AS reasons
FROM r LEFT JOIN t ON t.match_id=r.match_id AND t.player_id=r.player_id LEFT JOIN bad ON bad.match_id=r.match_id AND bad.player_id=r.player_id""",
    "ev",
)
def participation_minutes(v):
    _, rows = I.reconstruct(*match_sheets(v))
    return rows.select(
        "match_id", "team_id", "player_id", "minutes", "reliable", "quality",
        F.array_join("reasons", ";").alias("reasons"),
    )


@query(
    "nominal_minutes",
    "D7",
    f"""WITH {ENDS}, ok AS (SELECT match_id, max(CASE WHEN period = 2 THEN "offset" END) AS second FROM ends WHERE period IN (1, 2)
  GROUP BY match_id HAVING count(*) = 2 AND min(CASE WHEN length BETWEEN 2700 AND 3900 THEN 1 ELSE 0 END) = 1)
SELECT match_id, player_id, round((greatest(0, least(end_s, 2700) - greatest(start_s, 0))
  + greatest(0, least(end_s, second + 2700) - greatest(start_s, second))) / 60, 6) AS minutes FROM lu JOIN ok USING (match_id)""",
    "lu",
)
def nominal_minutes(v):
    out = I.nominal_minutes(v.lu, period_ends(v.ev))
    return out.withColumn("minutes", F.round("minutes", 6))


@query(
    "position_intervals",
    "D1",
    """WITH i AS (SELECT match_id, player_id, place, CASE WHEN place = 0 THEN start_s WHEN match_id % 4 = 0 THEN start_s + 500 ELSE start_s + 1000 END AS start_s,
  CASE WHEN place = 0 THEN start_s + 1000 WHEN match_id % 5 = 0 THEN end_s + 1 ELSE end_s END AS end_s, 5658e0 AS duration
  FROM lu, (VALUES (0), (1)) p(place)),
c AS (SELECT *, coalesce(lag(end_s) OVER (PARTITION BY match_id, player_id ORDER BY place), -1) AS prev FROM i)
SELECT match_id, player_id, round(sum(end_s - start_s) / 60, 6) AS listed_minutes,
 bool_and(start_s >= 0 AND start_s <= end_s AND end_s <= duration + 0.02e0 AND start_s >= prev - 0.02e0) AS listed_valid,
 count(*) AS listed_intervals FROM c GROUP BY ALL""",
    "lu",
)
def position_intervals(v):
    place = F.col("place")
    second = F.col("start_s") + F.when(F.col("match_id") % 4 == 0, 500.0).otherwise(1000.0)
    end = F.col("end_s") + F.when(F.col("match_id") % 5 == 0, 1.0).otherwise(0.0)
    rows = v.lu.withColumn("place", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "match_id",
        "player_id",
        "place",
        F.when(place == 0, F.col("start_s")).otherwise(second).alias("start_s"),
        F.when(place == 0, F.col("start_s") + 1000).otherwise(end).alias("end_s"),
        F.lit(5658.0).alias("duration"),
    )
    return I.position_total(rows).withColumn("listed_minutes", F.round("listed_minutes", 6))


@query(
    "context_in_interval",
    "E9 E10 D5",
    """WITH span AS (SELECT o_custkey, c_nationkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
o AS (SELECT c_nationkey, o_orderdate, o_orderpriority, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT s.o_custkey AS player_id, count(DISTINCT CASE WHEN o.o_orderpriority < '3' THEN (1, o.o_orderpriority, o.o_custkey % 7) END) AS own_possessions,
 count(DISTINCT CASE WHEN o.o_orderpriority >= '3' THEN (1, o.o_orderpriority, o.o_custkey % 7) END) AS opponent_possessions,
 count(*) FILTER (WHERE o.o_orderpriority < '3') AS team_passes
FROM span s JOIN o ON o.c_nationkey = s.c_nationkey AND o.o_orderdate BETWEEN s.a AND s.b GROUP BY s.o_custkey""",
)
def context_in_interval(v):
    orders = v.table("orders").join(
        v.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey"
    )
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double")
    side = F.when(F.col("o_orderpriority") < "3", 1).otherwise(2)
    events = orders.select(
        F.col("c_nationkey").alias("match_id"),
        at.alias("at"),
        F.lit(1).alias("period"),
        F.concat_ws("-", "o_orderpriority", (F.col("o_custkey") % 7).cast("string")).alias("possession"),
        side.alias("possession_team"),
        side.alias("team_id"),
        F.lit("Pass").alias("event_type"),
        F.lit(None).cast("string").alias("subtype"),
        F.col("o_orderkey").alias("event_id"),
    )
    spans = orders.groupBy(
        F.col("c_nationkey").alias("match_id"), F.col("o_custkey").alias("player_id")
    ).agg(F.min(at).alias("start_s"), F.max(at).alias("end_s"), F.lit(1).alias("team_id"))
    out = C.on_pitch_context(events, spans)
    return out.drop("match_id")


# -- D8: rosters, substitutions and cards -----------------------------------------------

D8_SQL = f"""
WITH {UNITS},
ok AS (SELECT match_id FROM ends WHERE period IN (1, 2) GROUP BY match_id HAVING count(*) = 2 AND min(length) >= 2400),
r AS (SELECT u.match_id, u.team_id, slot, CASE WHEN slot < 11 THEN u.team_id * 11 + slot ELSE 1000000 + u.team_id * 3 + slot - 11 END AS player_id,
   slot < 11 AS starter, CAST(u.match_id % 50 AS DOUBLE) + 40 AS m1 FROM units u JOIN ok USING (match_id), {SLOTS}),
iv AS (SELECT *, CASE WHEN slot < 11 THEN 0e0 WHEN slot = 11 THEN least(90, m1) WHEN slot = 12 AND match_id % 2 = 0 THEN 70e0 END AS s,
   CASE WHEN slot = 10 THEN least(90, m1) WHEN slot = 9 AND match_id % 2 = 0 THEN 70e0 WHEN slot < 12 THEN 90e0 WHEN slot = 12 AND match_id % 2 = 0 THEN 90e0 END AS e,
   match_id % 2 = 1 AND slot IN (12, 10) AS conflict FROM r),
acts AS (SELECT e.match_id, e.player_id, e.team_id, (period - 1) * 45 + least(45, clock / 60) AS "at", event_type = 'Pressure' AND k % 50 = 0 AS card
   FROM ev e JOIN ok USING (match_id) WHERE period < 5),
cards AS (SELECT match_id, player_id, min(acts."at") AS card_at FROM acts WHERE card GROUP BY ALL),
b AS (SELECT iv.*, card_at, least(e, CASE WHEN e IS NOT NULL THEN coalesce(card_at, e) END) AS fin FROM iv LEFT JOIN cards USING (match_id, player_id)),
o AS (SELECT b.match_id, b.player_id, bool_or(b.s IS NULL OR NOT (a."at" BETWEEN b.s - 2 AND b.fin + 2)) AS outside
   FROM b JOIN acts a USING (match_id, player_id) GROUP BY ALL),
z AS (SELECT b.*, o.outside, o.player_id IS NOT NULL AS acted, array_to_string(list_filter([
   CASE WHEN outside THEN 'action_outside_participation' END, CASE WHEN card_at < s THEN 'card_before_entry' END,
   CASE WHEN conflict THEN 'conflicting_substitution' END, CASE WHEN fin < s THEN 'negative_interval' END], lambda x: x IS NOT NULL), ';') AS reasons
 FROM b LEFT JOIN o USING (match_id, player_id))
SELECT match_id, team_id, player_id, CASE WHEN reasons = '' THEN round(coalesce(fin - s, 0), 6) END AS minutes, reasons = '' AS reliable, reasons,
 starter, s IS NOT NULL OR acted AS participated FROM z
"""


@query("roster_minutes", "D8", D8_SQL, "ev")
def roster_minutes(v):
    _, _, roster, _, _ = match_sheets(v)
    flat = v.ev.where(F.col("period") < 5)
    events = flat.select(
        "match_id",
        "player_id",
        "team_id",
        "period",
        "clock",
        ((F.col("event_type") == "Pressure") & (F.col("k") % 50 == 0)).alias("sent_off"),
    )
    rosters = roster.select(
        "match_id",
        "team_id",
        "player_id",
        (F.col("player_id") < 1000000).alias("starter"),
        F.lit(False).alias("stated_red"),
        F.lit(True).alias("formation_ok"),
    )
    units = roster.select("match_id", "team_id").distinct()
    slot = lambda s: F.col("team_id") * 11 + s
    bench = lambda s: F.lit(1000000) + F.col("team_id") * 3 + s
    first = units.select(
        "match_id", "team_id", (F.col("match_id") % 50 + 40).cast("double").alias("minute"),
        bench(0).alias("enters"), slot(10).alias("leaves"),
    )
    # Odd matches: the second substitution names a player already substituted.
    late = F.when(F.col("match_id") % 2 == 0, 70.0).otherwise(99.0)
    second = units.select(
        "match_id", "team_id", late.alias("minute"), bench(1).alias("enters"),
        F.when(F.col("match_id") % 2 == 0, slot(9)).otherwise(slot(10)).alias("leaves"),
    )
    matches = units.select("match_id", F.lit(True).alias("playable")).distinct()
    people = roster.select("player_id").distinct()
    out = I.roster_minutes(rosters, first.unionByName(second), events, matches, people)
    return out.withColumn("reasons", F.array_join("reasons", ";"))


@query(
    "fallback_rows",
    "D9",
    """WITH p AS (SELECT match_id, team_id, player_id, minutes FROM lu WHERE match_id % 4 <> 0),
f AS (SELECT match_id, min(team_id) AS team_id, player_id FROM ev WHERE match_id NOT IN (SELECT match_id FROM p) GROUP BY match_id, player_id)
SELECT match_id, team_id, player_id, round(minutes, 6) AS minutes, minutes IS NOT NULL AS reliable, '' AS reasons FROM p
UNION ALL SELECT match_id, team_id, player_id, NULL, FALSE, 'unreconciled_match' FROM f""",
    "ev lu",
)
def fallback_rows(v):
    known = v.lu.where(F.col("match_id") % 4 != 0).select(
        "match_id", "team_id", "player_id", F.round("minutes", 6).alias("minutes"),
        F.col("minutes").isNotNull().alias("reliable"), F.array().cast("array<string>").alias("reasons"),
    )
    out = I.with_fallback(known, v.ev, "unreconciled_match")
    return out.withColumn("reasons", F.array_join("reasons", ";"))
