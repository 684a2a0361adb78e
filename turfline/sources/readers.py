"""Readers and normalising projections of the source feeds.

Schemas are always given: no inference pass over the files, and nested fields a
query does not use are never parsed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turfline.functions.measures import reason_list
from turfline.functions.pitch import parse_pair, to_reference_pitch
from turfline.functions.text import clock_seconds, entity_key, position_group
from turfline.session import settle

EVENT_SCHEMA = """id string, match_id bigint, `index` bigint, period int, timestamp string,
type struct<id:int,name:string>, team struct<id:bigint>, player struct<id:bigint>, possession bigint,
possession_team struct<id:bigint>, location array<double>, counterpress boolean,
pass struct<end_location:array<double>,outcome:struct<name:string>,type:struct<name:string>,cross:boolean,
assisted_shot_id:string,shot_assist:boolean>,
shot struct<outcome:struct<name:string>,type:struct<name:string>,statsbomb_xg:double,key_pass_id:string>,
carry struct<end_location:array<double>>, duel struct<type:struct<name:string>>,
tactics struct<lineup:array<struct<player:struct<id:bigint>,position:struct<name:string>>>>,
substitution struct<replacement:struct<id:bigint>>, player_off struct<permanent:boolean>,
foul_committed struct<card:struct<name:string>>, bad_behaviour struct<card:struct<name:string>>"""

LINEUP_SCHEMA = """match_id bigint, team_id bigint, team_name string,
lineup array<struct<player_id:bigint,player_name:string,country:struct<name:string>,
positions:array<struct<position:string,`from`:string,`to`:string,from_period:int,to_period:int>>>>"""

TAGGED_SCHEMA = """id bigint, matchId bigint, teamId bigint, playerId bigint, matchPeriod string, eventSec double,
eventId int, eventName string, subEventId string, subEventName string, tags array<struct<id:int>>,
positions array<struct<x:double,y:double>>"""

TRACKING_SCHEMA = """match_id bigint, frame bigint, period int, timestamp string, possession struct<`group`:string>,
player_data array<struct<player_id:bigint,x:double,y:double,is_detected:boolean>>,
ball_data struct<x:double,y:double,z:double,is_detected:boolean>"""


def read_nested_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False, **equals) -> DataFrame:
    """A1/A3: nested records; JSON arrays in whole files with ``multi_line``."""
    df = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    for name, value in equals.items():
        df = df.where(F.col(name) == value)
    return df


def selected_matches(events: DataFrame, selected: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """A3: (rows of the selected matches, selected matches without any row)."""
    wanted = selected.select(F.col(selected.columns[0]).alias(key)).distinct()
    missing = wanted.join(events.select(key).distinct(), key, "left_anti")
    return events.join(wanted, key, "left_semi"), missing


def read_tracking(spark: SparkSession, path: str, first: int, last: int, stride: int) -> DataFrame:
    """A2: line-delimited tracking frames of a range, every ``stride``-th one."""
    frames = spark.read.schema(TRACKING_SCHEMA).json(path)
    return frames.where(
        F.col("frame").between(first, last) & ((F.col("frame") - first) % stride == 0)
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A4: text files as (file, line, raw), line numbers from 1.

    A large file is read by several tasks. Each byte range knows its start and the
    order of its own lines; the counts of the ranges before it, one small row per
    range, give the numbers. A line ends with a line feed, a carriage return before
    it is dropped, and an empty end of the file is no line.
    """
    meta = F.col("_metadata")
    ranges = ["path", "start"]
    read = settle(
        spark.read.option("lineSep", "\n").text(path).select(
            meta["file_path"].alias("path"),
            meta["file_block_start"].alias("start"),
            F.monotonically_increasing_id().alias("place"),
            F.regexp_replace("value", r"\r$", "").alias("raw"),
        ),
        "lines",
    )
    counted = read.groupBy(*ranges).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(*ranges, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return read.join(starts, ranges).select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        (F.col("place") - F.col("first") + F.col("before") + 1).cast("bigint").alias("line"),
        "raw",
    )


FIXTURE_FILE_SCHEMA = """name string,
matches array<struct<round:string,date:string,team1:string,team2:string,score:struct<ft:array<int>>>>,
rounds array<struct<name:string,matches:array<struct<round:string,date:string,team1:string,team2:string,score:struct<ft:array<int>>>>>>"""


def read_fixture_json(spark: SparkSession, path: str) -> DataFrame:
    """A5: fixtures listed flat or inside rounds."""
    doc = spark.read.schema(FIXTURE_FILE_SCHEMA).option("multiLine", True).json(path)
    listed = F.coalesce("matches", F.flatten("rounds.matches"))
    return doc.select("name", F.posexplode(listed).alias("place", "m")).select("name", "place", "m.*")


def read_csv_families(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """CSV families united; every value stays text inside a map."""
    parts = None
    for kind, path in paths.items():
        df = spark.read.option("header", True).csv(path)
        pairs = []
        for c in df.columns:
            pairs += [F.lit(c), F.col(c)]
        part = df.select(F.lit(kind).alias("kind"), F.create_map(*pairs).alias("record"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


# -- projections -----------------------------------------------------------------------


def _xy(location: Column, system: str) -> tuple[Column, Column]:
    x, y = F.try_element_at(location, F.lit(1)), F.try_element_at(location, F.lit(2))
    if system == "flipped":
        return to_reference_pitch(x, y, 120, 80, y_down=True, allow_outside=True)
    return parse_pair(x, y, 120.0, 80.0)


def canonical_events(raw: DataFrame, provider: str = "statsbomb", flipped: bool = True) -> DataFrame:
    """Flat typed events with outcome, subtype, locations and payload.

    ``flipped`` puts the origin bottom-left; otherwise coordinates stay upper-left
    and are dropped as a pair when outside.
    """
    kind = F.col("type.name")
    system = "flipped" if flipped else "upper"
    x, y = _xy(F.col("location"), system)
    ex, ey = _xy(F.coalesce("pass.end_location", "carry.end_location"), system)
    outcome = F.when(kind == "Pass", F.coalesce("pass.outcome.name", F.lit("Complete"))).otherwise(
        F.col("shot.outcome.name")
    )
    return raw.select(
        entity_key(provider, "events", "id").alias("event_key"),
        F.col("id").alias("event_id"),
        "match_id",
        F.col("index").alias("idx"),
        "period",
        clock_seconds("timestamp").alias("clock"),
        F.col("player.id").alias("player_id"),
        F.col("team.id").alias("team_id"),
        kind.alias("event_type"),
        F.coalesce("pass.type.name", "shot.type.name", "duel.type.name").alias("subtype"),
        outcome.alias("outcome"),
        x.alias("x"),
        y.alias("y"),
        ex.alias("end_x"),
        ey.alias("end_y"),
        F.col("shot.statsbomb_xg").alias("xg"),
        "possession",
        F.col("possession_team.id").alias("possession_team"),
        F.coalesce("pass.cross", F.lit(False)).alias("is_cross"),
        F.coalesce("counterpress", F.lit(False)).alias("counterpress"),
        F.col("pass.assisted_shot_id").alias("assisted_shot_id"),
        F.coalesce("pass.shot_assist", F.lit(False)).alias("shot_assist"),
        F.col("shot.key_pass_id").alias("key_pass_id"),
        F.coalesce("foul_committed.card.name", "bad_behaviour.card.name").alias("card"),
        F.col("substitution.replacement.id").alias("replacement_id"),
        F.col("player_off.permanent").alias("permanent"),
    )


def tactics(raw: DataFrame) -> DataFrame:
    """Listed players of line-up sheets and shifts."""
    return raw.where(F.col("tactics").isNotNull()).select(
        F.col("id").alias("event_id"), F.explode("tactics.lineup").alias("p")
    ).select("event_id", F.col("p.player.id").alias("player_id"), position_group("p.position.name").alias("role"))


# Nominal clock at which each period starts, in seconds.
PERIOD_CLOCK = {1: 0.0, 2: 2700.0, 3: 5400.0, 4: 6300.0, 5: 7200.0}


def lineup_positions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roster rows, listed position intervals) from nested line-ups."""
    players = raw.select("match_id", "team_id", F.explode("lineup").alias("p"))
    roster = players.select(
        "match_id",
        "team_id",
        F.col("p.player_id").alias("player_id"),
        F.col("p.player_name").alias("player_name"),
        F.col("p.country.name").alias("country"),
    )
    base = F.create_map(*[F.lit(x) for pair in PERIOD_CLOCK.items() for x in pair])
    at = lambda c, p: clock_seconds(c) - F.element_at(base, F.col(p))
    positions = players.select(
        "match_id", F.col("p.player_id").alias("player_id"), F.posexplode("p.positions").alias("place", "q")
    ).select(
        "match_id",
        "player_id",
        "place",
        position_group("q.position").alias("role"),
        F.col("q.from_period").alias("from_period"),
        at("q.from", "q.from_period").alias("from_clock"),
        F.when(F.col("q.to").isNotNull(), F.col("q.to_period")).alias("to_period"),
        F.when(F.col("q.to").isNotNull(), at("q.to", "q.to_period")).alias("to_clock"),
    )
    return roster, positions


def tracking_objects(frames: DataFrame, roster: DataFrame, length=105.0, width=68.0) -> DataFrame:
    """One row per located object of a frame; the ball has no player.

    The possession group names a side; the roster gives its team.
    """
    none = F.lit(None).cast("bigint")
    players = F.transform(
        "player_data",
        lambda p: F.struct(p["player_id"].alias("player_id"), F.lit("player").alias("kind"), p["x"].alias("x"), p["y"].alias("y"), p["is_detected"].alias("detected")),
    )
    ball = F.array(
        F.struct(none.alias("player_id"), F.lit("ball").alias("kind"), F.col("ball_data.x").alias("x"), F.col("ball_data.y").alias("y"), F.col("ball_data.is_detected").alias("detected"))
    )
    rows = frames.select(
        "match_id", "frame", "period", F.col("possession.group").alias("side"), F.explode(F.concat(players, ball)).alias("o")
    ).select("match_id", "frame", "period", "side", "o.*")
    located = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    x, y = to_reference_pitch("x", "y", length, width, centered=True, allow_outside=True)
    sides = roster.select("match_id", "side", F.col("team_id").alias("possession_team")).distinct()
    return located.withColumns({"x": x, "y": y}).join(sides, ["match_id", "side"], "left")


# Period labels of the tagged feed.
TAGGED_PERIODS = {"1H": 1, "2H": 2, "E1": 3, "E2": 4, "P": 5}


def tagged_events(raw: DataFrame, teams: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed events with sorted distinct tags, rejects with reasons)."""
    period = F.try_element_at(
        F.create_map(*[F.lit(x) for pair in TAGGED_PERIODS.items() for x in pair]), F.col("matchPeriod")
    )
    spot = lambda i: F.try_element_at("positions", F.lit(i))
    x, y = parse_pair(spot(1)["x"], spot(1)["y"], 100.0, 100.0)
    ex, ey = parse_pair(spot(2)["x"], spot(2)["y"], 100.0, 100.0)
    known_team = teams.select("match_id", "team_id", F.lit(True).alias("_team"))
    known = people.select("player_id", F.lit(True).alias("_person"))
    typed = raw.select(
        F.col("id").cast("string").alias("event_id"),
        F.col("matchId").alias("match_id"),
        F.col("playerId").alias("player_id"),
        F.col("teamId").alias("team_id"),
        period.alias("period"),
        F.col("eventSec").alias("clock"),
        F.col("eventId").alias("kind"),
        F.col("subEventId").cast("int").alias("sub"),
        F.array_sort(F.array_distinct(F.transform("tags", lambda t: t["id"]))).alias("tags"),
        x.alias("x"),
        y.alias("y"),
        ex.alias("end_x"),
        ey.alias("end_y"),
    )
    checked = (
        typed.join(known_team, ["match_id", "team_id"], "left")
        .join(known, "player_id", "left")
        .withColumn("player_known", F.coalesce("_person", F.lit(False)))
    )
    clock_ok = F.col("clock").between(0, 4500) & ~F.isnan("clock")
    reasons = reason_list(
        (F.col("_team").isNull(), "unknown_team_reference"),
        (F.col("period").isNull() | F.col("clock").isNull() | ~clock_ok, "invalid_period_or_clock"),
    )
    judged = checked.withColumn("reasons", reasons).drop("_team", "_person")
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def duplicate_events(events: DataFrame, keys: Sequence[str] = ("event_id",)) -> DataFrame:
    """Identifiers met more than once."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
