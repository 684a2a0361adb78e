"""Quality queries: C1-C20."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from turfline.operators import profiles as P
from turfline.operators import quality as Q
from turfline.plans.profiles import OBS_SQL, scoped_rows
from turfline.plans.registry import query
from turfline.plans.views import TABLES


def union(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "dq_contract",
    "C1",
    """SELECT 'minutes_range' AS rule, count(*) FILTER (WHERE NOT (minutes BETWEEN 5 AND 85)) AS violations FROM pm
 UNION ALL SELECT 'known_role', count(*) FILTER (WHERE role NOT IN ('CB','FB/WB','CM','W','ST','GK')) FROM pm
 UNION ALL SELECT 'missing_assists', count(*) FILTER (WHERE shot_assists IS NULL) FROM pm""",
    "pm",
)
def dq_contract(v):
    return Q.rule_violations(
        v.pm,
        {
            "minutes_range": ~F.col("minutes").between(5, 85),
            "known_role": ~F.col("role").isin("CB", "FB/WB", "CM", "W", "ST", "GK"),
            "missing_assists": F.col("shot_assists").isNull(),
        },
    )


@query(
    "dq_primary_key",
    "C2",
    """SELECT l_orderkey, l_linenumber, count(*) AS rows, 'duplicate_key' AS problem FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def dq_primary_key(v):
    return Q.key_violations(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


FKS = [
    ("customer_nation", "customer", "c_nationkey", "nation", "n_nationkey"),
    ("nation_region", "nation", "n_regionkey", "region", "r_regionkey"),
    ("supplier_nation", "supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders_customer", "orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem_part", "lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels_documents", "labels", "doc_id", "documents", "doc_id"),
    ("events_customer", "events", "user_id", "supplier", "s_suppkey"),
]


@query(
    "dq_foreign_keys",
    "C3",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS reference_name, count(DISTINCT c.{k}) AS missing_keys, count(c.{k}) AS rows
 FROM {ch} c WHERE c.{k} IS NOT NULL AND c.{k} NOT IN (SELECT {pk} FROM {pa})"""
        for n, ch, k, pa, pk in FKS
    ),
)
def dq_foreign_keys(v):
    return Q.foreign_key_report([(n, v.table(c), k, v.table(p), pk) for n, c, k, p, pk in FKS])


@query(
    "dq_membership",
    "C4",
    """WITH m AS (SELECT DISTINCT match_id, (match_id % 1000000) * 2 AS home, (match_id % 1000000) * 2 AS away FROM ev)
SELECT match_id, team_id, count(*) AS rows FROM ev JOIN m USING (match_id)
WHERE team_id <> home AND team_id <> away GROUP BY ALL""",
    "ev",
)
def dq_membership(v):
    side = (F.col("match_id") % 1000000) * 2
    pairs = v.ev.select("match_id").distinct().select(
        "match_id", side.alias("home"), side.alias("away")
    )
    return Q.outside_pair(v.ev, pairs, "match_id", "team_id", "home", "away")


@query(
    "dq_identical_sides",
    "C4",
    "SELECT o_orderkey AS match_id, o_custkey % 25 AS home FROM orders WHERE o_custkey % 25 = o_orderkey % 25",
)
def dq_identical_sides(v):
    pairs = v.table("orders").select(
        F.col("o_orderkey").alias("match_id"),
        (F.col("o_custkey") % 25).alias("home"),
        (F.col("o_orderkey") % 25).alias("away"),
    )
    return Q.identical_sides(pairs, "match_id", "home", "away")


@query(
    "dq_starters",
    "C5",
    """WITH u AS (SELECT DISTINCT m.match_id, m.match_id % 1000000 * 2 + s AS team_id FROM lu m JOIN (VALUES (0), (1)) t(s) ON TRUE)
SELECT u.match_id, u.team_id, count(l.player_id) FILTER (WHERE l.starter) AS found
FROM u LEFT JOIN lu l ON l.match_id = u.match_id AND l.team_id = u.team_id
GROUP BY ALL HAVING count(l.player_id) FILTER (WHERE l.starter) <> 9""",
    "lu",
)
def dq_starters(v):
    home = F.col("match_id") % 1000000 * 2
    units = v.lu.select("match_id").distinct().select(
        "match_id", F.explode(F.array(home, home + 1)).alias("team_id")
    )
    return Q.unexpected_cardinality(units, v.lu, ["match_id", "team_id"], F.col("starter"), 9)


COORD = "CASE WHEN k % 50 = 0 THEN NULL WHEN k % 51 = 0 THEN x + 20 ELSE x END"


@query(
    "dq_coordinates",
    "C6 C7",
    f"""WITH c AS (SELECT {COORD} AS x, y, end_x FROM ev)
SELECT 'half_pair' AS rule, count(*) FILTER (WHERE (x IS NULL) <> (y IS NULL)) AS violations FROM c
UNION ALL SELECT 'not_finite', 0 FROM c WHERE FALSE
UNION ALL SELECT 'not_finite', count(*) FILTER (WHERE FALSE) FROM c
UNION ALL SELECT 'outside_envelope', count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL AND NOT (x BETWEEN -10 AND 115 AND y BETWEEN -10 AND 78)) FROM c
UNION ALL SELECT 'off_pitch_retained', count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL AND NOT (x BETWEEN 0 AND 105 AND y BETWEEN 0 AND 68)) FROM c
UNION ALL SELECT 'minutes_unavailable', count(*) FILTER (WHERE end_x IS NULL) FROM c""",
    "ev",
)
def dq_coordinates(v):
    rows = v.ev.select(F.expr(COORD).alias("x"), "y", "end_x")
    return Q.rule_violations(
        rows, {**Q.coordinate_rules(), "minutes_unavailable": F.col("end_x").isNull()}
    )


@query(
    "dq_order",
    "C8",
    """WITH c AS (SELECT match_id, idx, CASE WHEN k % 20 = 0 THEN 1 ELSE period END AS period,
  CASE WHEN k % 10 = 3 THEN clock - 400 ELSE clock END AS clock FROM ev),
l AS (SELECT *, lag(period) OVER w AS p, lag(clock) OVER w AS c FROM c WINDOW w AS (PARTITION BY match_id ORDER BY idx))
SELECT match_id, count(*) FILTER (WHERE period < p) AS period_errors,
 count(*) FILTER (WHERE period = p AND clock < c) AS clock_inversions FROM l GROUP BY match_id""",
    "ev",
)
def dq_order(v):
    rows = v.ev.select(
        "match_id",
        "idx",
        F.when(F.col("k") % 20 == 0, 1).otherwise(F.col("period")).alias("period"),
        F.when(F.col("k") % 10 == 3, F.col("clock") - 400).otherwise(F.col("clock")).alias("clock"),
    )
    return Q.order_violations(rows, "match_id", "idx", "period", "clock", F.floor(F.col("idx") / 512))


@query(
    "dq_shot_ceiling",
    "C9",
    "SELECT match_id, count(*) AS n FROM ev WHERE event_type='Shot' GROUP BY match_id HAVING count(*) > 10",
    "ev",
)
def dq_shot_ceiling(v):
    return Q.above_ceiling(v.ev, "match_id", F.col("event_type") == "Shot", 10)


# Columns of the given tables.
COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


@query(
    "dq_nulls",
    "C10",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS nulls FROM {t}"
        for t, names in COLUMNS.items()
        for c in names.split()
    ),
)
def dq_nulls(v):
    return union([Q.null_profile(v.table(t), t) for t in TABLES])


@query(
    "dq_nulls_events",
    "C10",
    " UNION ALL ".join(
        f"SELECT 'ev' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS nulls FROM ev"
        for c in ("x", "y", "end_x", "end_y", "xg", "possession", "subtype", "outcome")
    ),
    "ev",
)
def dq_nulls_events(v):
    names = ["x", "y", "end_x", "end_y", "xg", "possession", "subtype", "outcome"]
    return Q.null_profile(v.ev.select(*names), "ev")


@query(
    "dq_conflicts",
    "C11",
    """SELECT p_name, count(*) AS variants FROM (SELECT DISTINCT p_name, p_type, p_brand FROM part) d
GROUP BY p_name HAVING count(*) > 1""",
)
def dq_conflicts(v):
    return Q.content_conflicts(v.table("part"), ["p_name"], ["p_type", "p_brand"])


@query(
    "dq_earliest_sighting",
    "C12",
    """SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderpriority)) AS o_orderpriority,
 CAST(min(o_orderdate) AS DATE) AS seen, count(DISTINCT o_orderpriority) > 1 AS conflict FROM orders GROUP BY o_custkey""",
)
def dq_earliest_sighting(v):
    rows = v.table("orders").withColumn("seen", F.to_date("o_orderdate"))
    return Q.earliest_sighting(rows, ["o_custkey"], ["o_orderpriority"], "seen")


@query(
    "dq_duplicate_ids",
    "C13",
    """SELECT id, count(*) AS rows, 'duplicate_key' AS problem FROM (SELECT event_id AS id FROM events
 UNION ALL SELECT o_orderkey FROM orders) u GROUP BY id HAVING count(*) > 1""",
)
def dq_duplicate_ids(v):
    ids = v.table("events").select(F.col("event_id").alias("id")).union(
        v.table("orders").select("o_orderkey")
    )
    return Q.key_violations(ids, ["id"])


@query(
    "dq_scope_counters",
    "C14 C18",
    """SELECT match_id % 1000000 AS scope, count(*) FILTER (WHERE TRUE) AS events,
 count(*) FILTER (WHERE x IS NULL) AS missing_location, count(*) FILTER (WHERE player_id % 10 = 0) AS unknown_actor,
 count(*) FILTER (WHERE event_type='Shot' AND xg IS NULL) AS missing_xg FROM ev GROUP BY 1""",
    "ev",
)
def dq_scope_counters(v):
    rows = v.ev.withColumn("scope", F.col("match_id") % 1000000)
    return Q.scope_counters(
        rows,
        ["scope"],
        {
            "events": F.lit(True),
            "missing_location": F.col("x").isNull(),
            "unknown_actor": F.col("player_id") % 10 == 0,
            "missing_xg": (F.col("event_type") == "Shot") & F.col("xg").isNull(),
        },
    )


@query(
    "dq_reason_histogram",
    "C14 C20 F22",
    f"WITH {OBS_SQL} SELECT scope, reason, count(*) AS n FROM obs WHERE reason IS NOT NULL GROUP BY ALL",
    "pm",
)
def dq_reason_histogram(v):
    return P.reason_histogram(scoped_rows(v), ["scope"])


@query(
    "dq_type_histogram",
    "C14 E17",
    "SELECT match_id % 1000000 AS scope, event_type, count(*) AS n FROM ev GROUP BY ALL",
    "ev",
)
def dq_type_histogram(v):
    rows = v.ev.withColumn("scope", F.col("match_id") % 1000000)
    return rows.groupBy("scope", "event_type").agg(F.count(F.lit(1)).alias("n"))


FIX = """fx AS (SELECT year(o_orderdate) AS season, o_custkey % 12 AS home, o_orderkey % 12 AS away, CAST(o_orderdate AS DATE) AS d FROM orders)"""


def fixtures(v):
    return v.table("orders").select(
        F.year("o_orderdate").cast("bigint").alias("season"),
        (F.col("o_custkey") % 12).alias("home"),
        (F.col("o_orderkey") % 12).alias("away"),
        F.to_date("o_orderdate").alias("d"),
    )


@query(
    "schedule_completeness",
    "C15",
    f"""WITH {FIX}, p AS (SELECT season, home, away, count(*) AS n FROM fx GROUP BY ALL),
t AS (SELECT season, count(DISTINCT team) AS teams FROM (SELECT season, home AS team FROM p UNION ALL SELECT season, away FROM p) s GROUP BY season),
q AS (SELECT season, count(*) AS unique_pairs, CAST(sum(n) AS BIGINT) AS matches FROM p WHERE home <> away GROUP BY season)
SELECT season, teams, unique_pairs, matches, teams * (teams - 1) AS expected,
 CASE WHEN unique_pairs = teams * (teams - 1) AND matches = teams * (teams - 1) THEN 'complete'
  WHEN unique_pairs >= 0.9e0 * teams * (teams - 1) THEN 'near' WHEN unique_pairs >= 0.5e0 * teams * (teams - 1) THEN 'partial' ELSE 'sample' END AS status
FROM t JOIN q USING (season)""",
)
def schedule_completeness(v):
    return Q.schedule_completeness(fixtures(v), ["season"], "home", "away")


@query(
    "season_catalogue",
    "C17",
    f"""WITH {FIX} SELECT season, count(*) AS matches, min(d) AS first_date, max(d) AS last_date,
 (SELECT count(DISTINCT team) FROM (SELECT season AS s, home AS team FROM fx UNION ALL SELECT season, away FROM fx) z WHERE z.s = fx.season) AS teams
FROM fx GROUP BY season""",
)
def season_catalogue(v):
    return Q.season_catalogue(fixtures(v), ["season"], "home", "away", "d")


@query(
    "roster_coverage",
    "C16",
    """SELECT season, competition_id, count(DISTINCT player_id) AS players, count(*) AS rows,
 round(avg(CASE WHEN role <> 'unknown' THEN 1e0 ELSE 0e0 END), 6) AS mapped_position,
 round(avg(CASE WHEN reliable THEN 1e0 ELSE 0e0 END), 6) AS interval_rows FROM pm GROUP BY ALL""",
    "pm",
)
def roster_coverage(v):
    out = Q.roster_coverage(
        v.pm,
        ["season", "competition_id"],
        {"mapped_position": F.col("role") != "unknown", "interval_rows": F.col("reliable")},
    )
    return out.withColumns({c: F.round(c, 6) for c in ("mapped_position", "interval_rows")})


@query(
    "provider_coverage",
    "C18",
    """SELECT provider, count(*) AS rows, count(DISTINCT match_id) AS matches, min(observed_on) AS first_date,
 max(observed_on) AS last_date, count(*) FILTER (WHERE minutes IS NULL) AS missing_minutes FROM lu GROUP BY provider""",
    "lu",
)
def provider_coverage(v):
    merged = v.lu.groupBy("provider", "match_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("observed_on").alias("a"),
        F.max("observed_on").alias("b"),
        F.count_if(F.col("minutes").isNull()).alias("m"),
    )
    return merged.groupBy("provider").agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("matches"),
        F.min("a").alias("first_date"),
        F.max("b").alias("last_date"),
        F.sum("m").alias("missing_minutes"),
    )


@query(
    "publication_gate",
    "C19",
    f"""WITH {FIX} SELECT season, count(*) AS matches FROM fx GROUP BY season""",
)
def publication_gate(v):
    summary = fixtures(v).groupBy("season").agg(F.count(F.lit(1)).alias("matches"))
    return Q.publication_gate(summary, F.col("matches") > 0, "partial data must not be published")


@query(
    "identity_audit",
    "C20",
    f"""WITH {OBS_SQL}, p AS (SELECT provider, player_id, count(*) AS n, count(reason) AS bad FROM obs GROUP BY ALL)
SELECT provider, count(*) AS identities, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (WHERE bad > 0) AS with_exclusions FROM p GROUP BY provider""",
    "pm",
)
def identity_audit(v):
    return Q.identity_audit(scoped_rows(v))
