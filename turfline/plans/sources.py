"""Source and layout queries: A1-A14, B10-B14. Files are written from the tables
into the shared folder and read back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline.functions.text import timestamp_date
from turfline.plans.counting import TAG_RULES, tagged
from turfline.plans.registry import query
from turfline.session import scratch_path
from turfline.sources import layout as A
from turfline.sources import readers as R
from turfline.streaming import incremental as N


def structured_json(v) -> str:
    """Events as nested structured records on disk."""
    path = scratch_path(v.spark, "structured")
    xy = lambda x, y: F.when(F.col(x).isNotNull(), F.array(F.col(x) / 105 * 120, (1 - F.col(y) / 68) * 80))
    named = lambda c: F.struct(c.alias("name"))
    kind = F.col("event_type")
    end = xy("end_x", "end_y")
    millis = F.round(F.col("clock") * 1000).cast("bigint")
    stamp = F.format_string(
        "%02d:%02d:%02d.%03d", F.floor(millis / 3600000), F.floor(millis / 60000) % 60, F.floor(millis / 1000) % 60, millis % 1000
    )
    v.ev.select(
        F.col("event_id").cast("string").alias("id"),
        "match_id",
        F.col("idx").alias("index"),
        "period",
        stamp.alias("timestamp"),
        named(kind).alias("type"),
        F.struct(F.col("team_id").alias("id")).alias("team"),
        F.struct(F.col("player_id").alias("id")).alias("player"),
        "possession",
        F.struct(F.col("possession_team").alias("id")).alias("possession_team"),
        xy("x", "y").alias("location"),
        "counterpress",
        F.when(
            kind == "Pass",
            F.struct(
                end.alias("end_location"),
                F.when(F.col("outcome") != "Complete", named(F.col("outcome"))).alias("outcome"),
                F.when(F.col("subtype").isNotNull(), named(F.col("subtype"))).alias("type"),
                F.col("is_cross").alias("cross"),
            ),
        ).alias("pass"),
        F.when(
            kind == "Shot",
            F.struct(
                named(F.col("outcome")).alias("outcome"), named(F.col("subtype")).alias("type"), F.col("xg").alias("statsbomb_xg")
            ),
        ).alias("shot"),
        F.when(kind == "Carry", F.struct(end.alias("end_location"))).alias("carry"),
        F.when(F.col("subtype") == "Tackle", F.struct(named(F.col("subtype")).alias("type"))).alias("duel"),
    ).write.json(path)
    return path


@query(
    "structured_events",
    "A1 B10 B2 B4",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, match_id, idx, CAST(period AS INT) AS period, round(clock, 3) AS clock, player_id, team_id, event_type, subtype, outcome,
 round(x, 6) AS x, round(y, 6) AS y, round(end_x, 6) AS end_x, round(end_y, 6) AS end_y, xg, possession, possession_team,
 CASE WHEN event_type = 'Pass' THEN is_cross ELSE FALSE END AS is_cross FROM ev""",
    "ev",
)
def structured_events(v):
    raw = R.read_nested_json(v.spark, structured_json(v), R.EVENT_SCHEMA)
    out = R.canonical_events(raw)
    places = {c: F.round(c, 6) for c in ("x", "y", "end_x", "end_y")}
    return out.withColumns({**places, "clock": F.round("clock", 3)}).select(
        "event_id", "match_id", "idx", "period", "clock", "player_id", "team_id", "event_type", "subtype", "outcome",
        "x", "y", "end_x", "end_y", "xg", "possession", "possession_team", "is_cross",
    )


@query(
    "upper_left_events",
    "A1 B7 B14",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, round(x, 5) AS x, round(68 - y, 5) AS y FROM ev""",
    "ev",
)
def upper_left_events(v):
    raw = R.read_nested_json(v.spark, structured_json(v), R.EVENT_SCHEMA)
    out = R.canonical_events(raw, flipped=False)
    return out.select("event_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query(
    "duplicate_events",
    "B14 C13",
    "SELECT CAST(user_id AS VARCHAR) AS event_id, count(*) AS rows FROM events GROUP BY user_id HAVING count(*) > 1",
)
def duplicate_events(v):
    ids = v.table("events").select(F.col("user_id").cast("string").alias("event_id"))
    return R.duplicate_events(ids)


@query(
    "lineup_positions",
    "A1 B8 B11",
    """SELECT match_id, player_id, 0 AS place, CASE WHEN starter THEN 'CB' ELSE 'ST' END AS role, 1 AS from_period, round(start_s, 3) AS from_clock FROM lu""",
    "lu",
)
def lineup_positions(v):
    path = scratch_path(v.spark, "lineups")
    stamp = F.format_string("00:%02d:%02d.000", F.floor(F.col("start_s") / 60), (F.col("start_s") % 60).cast("bigint"))
    position = F.struct(
        F.when(F.col("starter"), "Left Center Back").otherwise("Center Forward").alias("position"),
        stamp.alias("from"),
        F.lit(1).alias("from_period"),
    )
    player = F.struct("player_id", F.array(position).alias("positions"))
    v.lu.groupBy("match_id", "team_id").agg(F.collect_list(player).alias("lineup")).write.json(path)
    _, positions = R.lineup_positions(R.read_nested_json(v.spark, path, R.LINEUP_SCHEMA))
    return positions.select(
        "match_id", "player_id", "place", "role", "from_period", F.round("from_clock", 3).alias("from_clock")
    )


def tagged_json(v) -> str:
    path = scratch_path(v.spark, "tagged")
    spot = lambda x, y: F.struct((F.col(x) / 1.05).alias("x"), (F.col(y) / 0.68).alias("y"))
    v_tagged = tagged(v)
    doubled = F.concat("tags", "tags")
    v_tagged.select(
        F.col("event_id").alias("id"),
        F.col("match_id").alias("matchId"),
        F.col("team_id").alias("teamId"),
        F.col("player_id").alias("playerId"),
        F.when(F.col("period") == 1, "1H").when(F.col("period") == 2, "2H").otherwise("X").alias("matchPeriod"),
        F.col("clock").alias("eventSec"),
        F.col("kind").alias("eventId"),
        F.col("sub").cast("string").alias("subEventId"),
        F.transform(doubled, lambda t: F.struct(t.alias("id"))).alias("tags"),
        F.array(spot("x", "y"), spot("end_x", "end_y")).alias("positions"),
    ).write.json(path)
    return path


def tagged_rows(v):
    raw = R.read_nested_json(v.spark, tagged_json(v), R.TAGGED_SCHEMA)
    teams = v.ev.select("match_id", "team_id").where(F.col("team_id") % 5 != 0).distinct()
    people = v.table("customer").select(F.col("c_custkey").alias("player_id"))
    return R.tagged_events(raw, teams, people)


TAG_TEXT = "array_to_string(list_sort(list_filter([" + ", ".join(
    f"CASE WHEN {r} THEN {c} END" for c, r in TAG_RULES.items()
) + "], lambda z: z IS NOT NULL)), ',')"


@query(
    "tagged_events",
    "A3 B13 B7",
    f"SELECT CAST(event_id AS VARCHAR) AS event_id, match_id, player_id, CAST(period AS INT) AS period, {TAG_TEXT} AS tags, round(x, 4) AS x, round(end_y, 4) AS end_y, TRUE AS player_known FROM ev WHERE period < 3 AND team_id % 5 <> 0",
    "ev",
)
def tagged_events(v):
    rows, _ = tagged_rows(v)
    return rows.select(
        "event_id", "match_id", "player_id", "period", F.array_join("tags", ",").alias("tags"),
        F.round("x", 4).alias("x"), F.round("end_y", 4).alias("end_y"), "player_known",
    )


@query(
    "tagged_rejects",
    "B13",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, array_to_string(list_filter([CASE WHEN team_id % 5 = 0 THEN 'unknown_team_reference' END,
 CASE WHEN period > 2 THEN 'invalid_period_or_clock' END], lambda z: z IS NOT NULL), ';') AS reasons FROM ev WHERE period > 2 OR team_id % 5 = 0""",
    "ev",
)
def tagged_rejects(v):
    return tagged_rows(v)[1].select("event_id", F.array_join("reasons", ";").alias("reasons"))


@query(
    "selected_matches",
    "A3",
    "SELECT match_id, count(*) AS rows FROM ev WHERE match_id % 3 = 0 GROUP BY match_id UNION ALL SELECT n_nationkey, 0 FROM nation WHERE n_nationkey % 3 = 0",
    "ev",
)
def selected_matches(v):
    wanted = v.ev.select("match_id").where(F.col("match_id") % 3 == 0).union(
        v.table("nation").where(F.col("n_nationkey") % 3 == 0).select(F.col("n_nationkey").cast("bigint"))
    )
    rows, missing = R.selected_matches(v.ev, wanted, "match_id")
    found = rows.groupBy("match_id").agg(F.count(F.lit(1)).alias("rows"))
    return found.unionByName(missing.select("match_id", F.lit(0).cast("bigint").alias("rows")))


TRACK = "event_id BETWEEN 10 AND (SELECT max(event_id) - 5 FROM events) AND (event_id - 10) % 3 = 0"


@query(
    "tracking_objects",
    "A2 B4 B12",
    f"""WITH f AS (SELECT * FROM ev WHERE {TRACK})
SELECT match_id, event_id AS frame, 'player' AS kind, player_id, round(x, 6) AS x, round(y, 6) AS y, team_id AS possession_team FROM f WHERE x IS NOT NULL AND y IS NOT NULL
UNION ALL SELECT match_id, event_id, 'ball', NULL, round(end_x, 6), round(end_y, 6), team_id FROM f WHERE end_x IS NOT NULL AND end_y IS NOT NULL""",
    "ev",
)
def tracking_objects(v):
    path = scratch_path(v.spark, "tracking")
    off = lambda c, half: F.col(c) - half
    v.ev.select(
        "match_id",
        F.col("event_id").alias("frame"),
        "period",
        F.struct(F.when(F.col("team_id") % 2 == 0, "home").otherwise("away").alias("group")).alias("possession"),
        F.array(
            F.struct("player_id", off("x", 52.5).alias("x"), off("y", 34).alias("y"), F.lit(True).alias("is_detected"))
        ).alias("player_data"),
        F.struct(off("end_x", 52.5).alias("x"), off("end_y", 34).alias("y")).alias("ball_data"),
    ).write.json(path)
    last = v.table("events").agg(F.max("event_id")).first()[0] - 5
    frames = R.read_tracking(v.spark, path, 10, last, 3)
    roster = v.ev.select(
        "match_id", "team_id", F.when(F.col("team_id") % 2 == 0, "home").otherwise("away").alias("side")
    ).distinct()
    out = R.tracking_objects(frames, roster)
    return out.select(
        "match_id", "frame", "kind", "player_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "possession_team"
    )


@query(
    "text_lines",
    "A4",
    "SELECT p_brand AS brand, count(*) AS lines, min(line) AS first, max(line) AS last FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS line FROM part) z GROUP BY p_brand",
)
def text_lines(v):
    path = scratch_path(v.spark, "lines")
    v.table("part").select("p_brand", F.concat_ws(" ", "p_brand", "p_name").alias("value")).repartition(
        "p_brand"
    ).sortWithinPartitions("p_brand").write.partitionBy("p_brand").text(path)
    lines = R.read_lines(v.spark, f"{path}/*/*.txt").where(F.col("raw") != "")
    brand = F.split("raw", " ").getItem(0)
    return lines.groupBy(brand.alias("brand")).agg(
        F.count(F.lit(1)).alias("lines"), F.min("line").alias("first"), F.max("line").alias("last")
    )


@query(
    "fixture_json",
    "A5 L4 B18",
    """SELECT o_orderpriority AS name, o_orderkey % 7 AS team1, CAST(o_orderdate AS DATE) AS date, count(*) AS n, CAST(sum(o_orderkey % 4) AS BIGINT) AS goals FROM orders GROUP BY ALL""",
)
def fixture_json(v):
    path = scratch_path(v.spark, "fixtures")
    k = F.col("o_orderkey")
    game = F.struct(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date"),
        (k % 7).cast("string").alias("team1"),
        F.lit("x").alias("team2"),
        F.struct(F.array((k % 4).cast("int"), F.lit(0)).alias("ft")).alias("score"),
    )
    # Half of the files list matches flat, the others inside rounds.
    grouped = v.table("orders").groupBy(F.col("o_orderpriority").alias("name"), (k % 64).alias("part")).agg(
        F.collect_list(game).alias("m")
    )
    flat = F.col("part") % 2 == 0
    grouped.select(
        "name",
        F.when(flat, F.col("m")).alias("matches"),
        F.when(~flat, F.array(F.struct(F.lit("r").alias("name"), F.col("m").alias("matches")))).alias("rounds"),
    ).write.option("maxRecordsPerFile", 1).json(path)
    rows = R.read_fixture_json(v.spark, path)
    return rows.groupBy("name", F.col("team1").cast("bigint").alias("team1"), timestamp_date("date").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.element_at("score.ft", 1)).alias("goals")
    )


@query(
    "csv_families",
    "A6",
    """SELECT 'supplier' AS kind, count(*) AS rows, CAST(sum(s_suppkey) AS BIGINT) AS checksum FROM supplier UNION ALL SELECT 'customer', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer
 UNION ALL SELECT 'nation', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM nation""",
)
def csv_families(v):
    paths, key = {}, {"supplier": "s_suppkey", "customer": "c_custkey", "nation": "n_nationkey"}
    for name in key:
        paths[name] = scratch_path(v.spark, f"csv-{name}")
        v.table(name).write.option("header", True).csv(paths[name])
    ident = F.coalesce(*[F.try_element_at("record", F.lit(c)) for c in key.values()])
    return R.read_csv_families(v.spark, paths).groupBy("kind").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(ident.cast("bigint")).alias("checksum")
    )


@query(
    "canonical_table",
    "A7 A8 A9",
    "SELECT competition_id, season, count(*) AS rows, sum(minutes) AS minutes FROM pm WHERE competition_id = 1 GROUP BY ALL",
    "pm",
)
def canonical_table(v):
    path = scratch_path(v.spark, "layout")
    schema = T.StructType.fromDDL(
        "match_id bigint, player_id bigint, minutes double, note string, competition_id bigint, season bigint"
    )
    A.write_table(A.conform(v.pm, schema), path, "match_id", ["competition_id", "season"])
    table = A.read_table(v.spark, path, schema)
    return table.where("competition_id = 1").groupBy("competition_id", "season").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("minutes").alias("minutes")
    )


@query(
    "profile_views",
    "A10",
    "SELECT CAST(competition_id AS VARCHAR) || '-' || CAST(season AS VARCHAR) AS scope, count(DISTINCT player_id) AS players FROM pm GROUP BY 1",
    "pm",
)
def profile_views(v):
    from turfline.plans.profiles import REQUIRED, scoped

    A.register_profile_views(scoped(v), REQUIRED)
    return v.spark.sql(
        "SELECT s.scope, count(*) AS players FROM player_season s JOIN eligibility e USING (scope, player_id) GROUP BY s.scope"
    )


@query(
    "sharded_details",
    "A11",
    "SELECT lpad(right(CAST(c_custkey AS VARCHAR), 2), 2, '0') AS shard, count(*) AS n FROM customer GROUP BY 1",
)
def sharded_details(v):
    path = scratch_path(v.spark, "shards")
    A.write_sharded_json(v.table("customer"), path, "c_custkey")
    read = v.spark.read.schema("c_custkey bigint, shard string").option("basePath", path).json(path)
    return read.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query(
    "manifest",
    "A12",
    "SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'part', count(*) FROM part",
)
def manifest(v):
    return A.manifest({t: v.table(t) for t in ("orders", "events", "part")})


@query(
    "stale_partitions",
    "A13",
    "SELECT DISTINCT season FROM pm WHERE match_id % 1000 = 7",
    "pm",
)
def stale_partitions(v):
    version, part, content = "1", ["season"], ["match_id", "minutes"]
    before = N.processing_keys(v.pm, part, content, version)
    changed = v.pm.withColumn(
        "minutes", F.when(F.col("match_id") % 1000 == 7, F.col("minutes") + 1).otherwise(F.col("minutes"))
    )
    keys = N.processing_keys(changed, part, content, version)
    return N.stale_partitions(keys, before, part).select("season")


@query(
    "file_audit",
    "A12 A14",
    "SELECT CAST(count(DISTINCT o_orderpriority) AS BIGINT) - 2 AS unchanged, 1 AS missing, 2 AS other FROM orders",
)
def file_audit(v):
    path = scratch_path(v.spark, "audit")
    v.table("orders").repartition("o_orderpriority").write.partitionBy("o_orderpriority").json(path)
    found = A.file_checksums(v.spark, path).withColumn("n", F.lit(1))
    # One file lost, one changed and one unexpected, against the lock of all files.
    names = found.agg(F.min("file").alias("low"), F.max("file").alias("high"))  # one row
    lock = found.join(F.broadcast(names)).select(
        F.when(F.col("file") == F.col("low"), F.concat(F.lit("lost-"), F.col("file"))).otherwise(F.col("file")).alias("file"),
        F.when(F.col("file") == F.col("high"), F.lit("0")).otherwise(F.col("sha256")).alias("sha256"),
    )
    problems = A.audit_files(found, lock).agg(
        F.count_if(F.col("problem") == "missing").alias("m"), F.count_if(F.col("problem") != "missing").alias("o")
    )
    total = found.agg(F.count(F.lit(1)).alias("t"))
    return problems.join(F.broadcast(total)).select(
        (F.col("t") - F.col("o")).alias("unchanged"), F.col("m").cast("int").alias("missing"), F.col("o").cast("int").alias("other")
    )
