"""Event counting: one conditional aggregate per (unit, actor), E5-E18.

Events carry: match_id, event_id, idx, period, clock, player_id, team_id,
event_type, subtype, outcome, x, y, end_x, end_y, xg, possession,
possession_team, is_cross, counterpress (and, for assists, assisted_shot_id,
shot_assist, key_pass_id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.functions import pitch
from turfline.functions.constants import (
    SET_PIECES,
    TAG_ACCURATE,
    TAG_BLOCKED,
    TAG_GOAL_ZONES,
    TAG_INACCURATE,
    TAG_INTERCEPTION,
    TAG_KEY_PASS,
    TAG_LOST,
    TAG_NEUTRAL,
    TAG_SLIDING,
    TAG_WON,
)
from turfline.functions.measures import count_where, null_safe_in, poisoned_sum
from turfline.operators.ordering import value_ladder
from turfline.session import settle

XY = ("x", "y", "end_x", "end_y")
#: Moments on the clock lie between -END and END; BEFORE comes before all of them.
END, BEFORE = 1e300, -1e301


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def _in_play() -> Column:
    return F.col("period") < 5


def _open_pass() -> Column:
    return _is("Pass") & ~null_safe_in(F.col("subtype"), SET_PIECES)


def _shot() -> Column:
    return _is("Shot") & ~F.col("subtype").eqNullSafe("Penalty")


def _unlocated() -> Column:
    return F.greatest(*[F.col(c).isNull() for c in XY])


def link_assists(events: DataFrame) -> DataFrame:
    """Mark passes that name an assisted shot: valid, penalty or invalid link.

    Only passes with a link and shots with a key pass are joined; the rest of the
    events never shuffle for it.
    """
    claims = events.where(
        _is("Pass") & (F.col("assisted_shot_id").isNotNull() | F.col("shot_assist"))
    ).select("match_id", "event_id", "idx", "team_id", "assisted_shot_id")
    shots = events.where(_is("Shot") & _in_play()).select(
        "match_id",
        F.col("event_id").alias("assisted_shot_id"),
        F.col("idx").alias("shot_idx"),
        F.col("team_id").alias("shot_team"),
        F.col("key_pass_id"),
        F.col("xg").alias("shot_xg"),
        F.col("subtype").eqNullSafe("Penalty").alias("shot_penalty"),
    )
    valid = (
        (F.col("shot_team") == F.col("team_id"))
        & (F.col("shot_idx") > F.col("idx"))
        & (F.col("key_pass_id") == F.col("event_id"))
    )
    state = (
        F.when(~F.coalesce(valid, F.lit(False)), "invalid")
        .when(F.col("shot_penalty"), "penalty")
        .otherwise("valid")
    )
    linked = claims.join(shots, ["match_id", "assisted_shot_id"], "left").select(
        "match_id", "event_id", state.alias("assist_state"), F.col("shot_xg").alias("assist_xg")
    )
    return events.join(linked, ["match_id", "event_id"], "left")


def style_counts(with_assists: bool = True) -> list[Column]:
    """The 18 style counts plus goals, npxg, xa and completed passes."""
    shot, opened, carry = _shot(), _open_pass(), _is("Carry")
    complete = opened & (F.col("outcome") == "Complete")
    unlocated = _unlocated()
    x, y, ex, ey = XY
    progressive = F.coalesce(pitch.progressive_relative(*XY), F.lit(False))
    to_box = F.coalesce(pitch.enters_box(*XY), F.lit(False))
    to_third = F.coalesce(pitch.enters_final_third(x, ex), F.lit(False))
    far = F.coalesce(pitch.travelled(*XY) >= 30, F.lit(False))
    no_start = F.col(x).isNull() | F.col(y).isNull()
    counts = {
        "shots": count_where(shot),
        "goals": count_where(shot & (F.col("outcome") == "Goal")),
        "npxg": poisoned_sum("xg", shot, F.col("xg").isNull()),
        "box_shots": poisoned_sum(
            F.coalesce(pitch.in_box(x, y), F.lit(False)).cast("int"), shot, no_start
        ),
        "passes": count_where(opened),
        "completed_passes": count_where(complete),
        "crosses": count_where(complete & F.col("is_cross")),
        "long_passes": poisoned_sum(far.cast("int"), opened, unlocated),
        "progressive_passes": poisoned_sum(
            (progressive & complete).cast("int"), opened, unlocated
        ),
        "final_third_passes": poisoned_sum((to_third & complete).cast("int"), opened, unlocated),
        "box_passes": poisoned_sum((to_box & complete).cast("int"), opened, unlocated),
        "carries": count_where(carry),
        "progressive_carries": poisoned_sum(progressive.cast("int"), carry, unlocated),
        "carry_distance": poisoned_sum(pitch.travelled(*XY), carry, unlocated),
        "box_carries": poisoned_sum(to_box.cast("int"), carry, unlocated),
        "pressures": count_where(_is("Pressure")),
        "counterpressures": count_where(_is("Pressure") & F.col("counterpress")),
        "tackles": count_where(_is("Duel") & (F.col("subtype") == "Tackle")),
        "interceptions": count_where(_is("Interception")),
        "recoveries": count_where(_is("Ball Recovery")),
    }
    if with_assists:
        state = F.col("assist_state")
        claimed, broken = state.isin("valid", "invalid"), state == "invalid"
        counts["shot_assists"] = poisoned_sum(F.lit(1), claimed, broken)
        counts["xa"] = poisoned_sum("assist_xg", claimed, broken | F.col("assist_xg").isNull())
    return [c.alias(name) for name, c in counts.items()]


def actor_counts(
    events: DataFrame, keys: Sequence[str], with_assists: bool = False
) -> DataFrame:
    """E5 for any actor key; the aggregate combines map-side before the shuffle."""
    return events.where(_in_play()).groupBy(*keys).agg(*style_counts(with_assists))


def grid_bins(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Passes, carries and shots per 12 x 8 cell."""
    gx, gy = pitch.grid_cell("x", "y")
    located = F.col("event_type").isin("Pass", "Carry", "Shot") & pitch.on_pitch("x", "y")
    return (
        events.where(_in_play() & located)
        .groupBy(*keys, gx.alias("bx"), gy.alias("by"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def nested_bins(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """cells merged over matches as one array of at most 96 structs."""
    merged = bins.groupBy(*keys, "bx", "by").agg(F.sum("n").alias("n"))
    return merged.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("bx", "by", "n"))).alias("bins")
    )


def match_clock(events: DataFrame, ends: DataFrame) -> DataFrame:
    """Elapsed seconds ``at`` = ends of earlier periods + clock (B3 applied)."""
    return events.join(ends.select("match_id", "period", "offset"), ["match_id", "period"]).withColumn(
        "at", F.col("offset") + F.col("clock")
    )


def on_pitch_context(events: DataFrame, intervals: DataFrame) -> DataFrame:
    """Distinct own/opponent possessions and team passes while on the pitch.

    ``intervals`` has match_id, player_id, team_id, start_s, end_s; several rows per player add
    up; a missing bound or an end before the start gives nothing. No event meets the
    intervals of its match: one interval is a difference of counts along the clock, and only
    players with several are met band by band.
    """
    slim = events.where(F.col("period") <= 4).select(
        "match_id",
        "at",
        "period",
        "possession",
        "possession_team",
        F.col("team_id").alias("actor_team"),
        _open_pass().cast("bigint").alias("passes"),
    )
    names = ["match_id", "player_id", "team_id", "start_s", "end_s"]
    whole = intervals.select(*names).where(F.col("start_s") <= F.col("end_s"))
    listed = whole.groupBy("match_id", "player_id").agg(F.collect_list(F.struct(*names[2:])).alias("s"))
    listed = settle(listed, "spans")
    several = listed.where(F.size("s") > 1)
    out = _context_by_counts(slim, listed.where(F.size("s") == 1).select("match_id", "player_id", F.explode("s").alias("s")).select("match_id", "player_id", "s.*"))
    if several.isEmpty():
        return out
    more = several.select("match_id", "player_id", F.explode("s").alias("s")).select("match_id", "player_id", "s.*")
    return out.unionByName(_context_in_bands(slim, more))


def _context_by_counts(slim: DataFrame, spans: DataFrame) -> DataFrame:
    """Context of one interval per player.

    Events and passes are differences of running sums. A possession lies in [a, b] if it has an
    event there, and exactly one of these follows no other of it in [a, b]: events up to b whose
    predecessor is before a, less the events before a. Those pairs of (event, predecessor) are
    counted by the dyadic bands of events that make up the events to b: a row per binary digit.
    """
    keyed = F.col("possession").isNotNull() & F.col("possession_team").isNotNull()
    clock = lambda c: F.greatest(F.lit(-END), F.least(F.lit(END), F.col(c).cast("double")))
    moments = slim.where(F.col("at").isNotNull()).withColumns({"at": clock("at"), "keyed": keyed})
    spans = spans.withColumns({c: clock(c) for c in ("start_s", "end_s")})
    asked = spans.select("match_id", "start_s", "end_s").distinct()
    ends = asked.select("match_id", F.explode(F.array("start_s", "end_s")).alias("at"))

    def inside(rows: DataFrame, edges: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
        """(keys, at) with the sums of all rows before and of all rows up to that moment."""
        marked = rows.select(*keys, "at", *sums).unionByName(edges.select(*keys, "at", *[F.lit(0).cast("bigint").alias(c) for c in sums]))
        ladder = value_ladder(marked, keys, "at", {c: F.col(c) for c in sums})
        return ladder.select(
            *keys, "at", *[F.col(f"{c}_below").alias(f"{c}_before") for c in sums], *[(F.col(f"{c}_below") + F.col(c)).alias(f"{c}_upto") for c in sums],
            *[F.col(f"{c}_total") for c in sums],
        )

    def between(rows: DataFrame, sums: DataFrame, keys: list[str], names: list[str], how: str = "inner") -> DataFrame:
        start = sums.select(*keys, F.col("at").alias("start_s"), *[F.col(f"{c}_before") for c in names])
        end = sums.select(*keys, F.col("at").alias("end_s"), *[F.col(f"{c}_upto") for c in names])
        met = rows.join(start, [*keys, "start_s"], how).join(end, [*keys, "end_s"], how)
        return met.select(*rows.columns, *[(F.col(f"{c}_upto") - F.col(f"{c}_before")).alias(c) for c in names])

    every = moments.withColumns({"events": F.lit(1).cast("bigint"), "loose": (~F.col("keyed")).cast("bigint")})
    sums = settle(inside(every, ends, ["match_id"], ["events", "loose"]), "moments")
    rows = between(spans, sums, ["match_id"], ["events", "loose"]).where(F.col("events") > 0)
    passed = moments.where("keyed").select("match_id", F.col("actor_team").alias("team_id"), "at", "passes").where(F.col("team_id").isNotNull())
    sides = spans.select("match_id", "team_id", F.explode(F.array("start_s", "end_s")).alias("at")).where(F.col("team_id").isNotNull())
    sums = settle(inside(passed, sides, ["match_id", "team_id"], ["passes"]), "passes")
    rows = between(rows, sums, ["match_id", "team_id"], ["passes"], "left")

    holder = ["match_id", "possession_team"]
    along = Window.partitionBy(*holder, "period", "possession").orderBy("at")
    marks = moments.where("keyed").select(*holder, "period", "possession", "at").distinct()
    marks = settle(marks.withColumns({"prior": F.coalesce(F.lag("at").over(along), F.lit(BEFORE)), "n": F.lit(1).cast("bigint")}), "marks")
    wanted = marks.select(*holder).distinct().join(asked, "match_id")
    places = settle(inside(marks, wanted.select(*holder, F.explode(F.array("start_s", "end_s")).alias("at")), holder, ["n"]), "places")
    point = marks.select(*holder, "at", "prior").join(places.select(*holder, "at", "n_before", "n_total"), [*holder, "at"])
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.col("n_total") + 0.5)).cast("int"))
    band = lambda c, level: F.call_function("shiftright", c, level)
    bands = point.withColumn("level", F.explode(levels)).withColumn("band", band(F.col("n_before"), F.col("level"))).where(F.col("band") % 2 == 0)
    asks = wanted.join(
        places.select(*holder, F.col("at").alias("end_s"), "n_upto", "n_total"), [*holder, "end_s"]
    ).join(places.select(*holder, F.col("at").alias("start_s"), "n_before"), [*holder, "start_s"])
    asks = settle(asks.where(F.col("n_upto") > F.col("n_before")), "asks")
    parts = asks.withColumn("level", F.explode(levels)).withColumn("band", band(F.col("n_upto"), F.col("level")) - 1).where(F.col("band") % 2 == 0)
    node = [*holder, "level", "band"]
    both = bands.select(*node, F.col("prior").alias("edge"), F.lit(1).alias("n")).unionByName(
        parts.select(*node, F.col("start_s").alias("edge"), F.lit(0).alias("n"))
    )
    ladder = value_ladder(both, node, "edge", {"n": F.col("n")}).select(*node, "edge", "n_below")
    fresh = parts.withColumn("edge", F.col("start_s")).join(ladder, [*node, "edge"]).groupBy(*holder, "start_s", "end_s").agg(
        (F.sum("n_below") - F.max("n_before")).alias("found")
    )
    own = F.col("possession_team") == F.col("team_id")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("found"))), F.lit(0))
    complete = F.max("loose") == 0
    return rows.join(fresh, ["match_id", "start_s", "end_s"], "left").groupBy("match_id", "player_id").agg(
        F.when(complete, total(own)).alias("own_possessions"),
        F.when(complete, total(~own)).alias("opponent_possessions"),
        F.coalesce(F.max("passes"), F.lit(0)).alias("team_passes"),
    )


def _context_in_bands(slim: DataFrame, intervals: DataFrame) -> DataFrame:
    """Context of players with several intervals in a match, whose possessions count once.

    Time is cut into about the square root of a match's events many bands. A band inside an
    interval counts by its merged possessions; only the bands that hold an end of the
    interval are met event by event.
    """
    extent = slim.groupBy("match_id").agg(
        F.min("at").alias("_from"), F.max("at").alias("_to"), F.ceil(F.sqrt(F.count("at"))).alias("_bands")
    ).where(F.col("_bands") > 0)
    width = F.when(F.col("_to") > F.col("_from"), (F.col("_to") - F.col("_from")) / F.col("_bands")).otherwise(1.0)
    extent = extent.select("match_id", "_from", "_to", "_bands", width.alias("_width"))
    # Clamped before the cast; monotone in the clock, so a band strictly between
    # those of both ends lies inside the interval.
    band = lambda c: F.greatest(
        F.lit(0.0), F.least(F.floor((F.col(c) - F.col("_from")) / F.col("_width")).cast("double"), F.col("_bands") - 1.0)
    ).cast("bigint")
    shape = ["match_id", "band", "edge", "at", "period", "possession", "possession_team", "actor_team", "passes"]
    banded = slim.where(F.col("at").isNotNull()).join(extent, "match_id").withColumn("band", band("at"))
    merged = (
        banded.groupBy("match_id", "band", "period", "possession", "possession_team", "actor_team")
        .agg(F.sum("passes").alias("passes"))
        .withColumns({"edge": F.lit(False), "at": F.lit(None).cast("double")})
    )
    moments = banded.withColumns({"edge": F.lit(True), "at": F.col("at").cast("double")})
    met = (
        intervals.select("match_id", "player_id", "team_id", "start_s", "end_s")
        .join(extent, "match_id")
        .where(
            (F.col("start_s") <= F.col("end_s")) & (F.col("start_s") <= F.col("_to")) & (F.col("end_s") >= F.col("_from"))
        )
        .withColumns({"_first": band("start_s"), "_last": band("end_s")})
        .withColumn("band", F.explode(F.sequence("_first", "_last")))
        .withColumn("edge", F.col("band").isin(F.col("_first"), F.col("_last")))
        .select("match_id", "band", "edge", "player_id", "team_id", "start_s", "end_s")
    )
    inside = (
        merged.select(*shape)
        .unionByName(moments.select(*shape))
        .join(met, ["match_id", "band", "edge"])
        .where(~F.col("edge") | F.col("at").between(F.col("start_s"), F.col("end_s")))
    )
    keyed = F.col("possession").isNotNull() & F.col("possession_team").isNotNull()
    per_key = inside.groupBy(
        "match_id", "player_id", "team_id", "period", "possession", "possession_team"
    ).agg(
        F.min(keyed).alias("keyed"),
        F.coalesce(
            F.sum(F.when(keyed & (F.col("actor_team") == F.col("team_id")), F.col("passes"))), F.lit(0)
        ).alias("team_passes"),
    )
    own = F.col("possession_team") == F.col("team_id")
    complete = F.min("keyed")
    return per_key.groupBy("match_id", "player_id").agg(
        F.when(complete, F.count_if(F.col("keyed") & own)).alias("own_possessions"),
        F.when(complete, F.count_if(F.col("keyed") & ~own)).alias("opponent_possessions"),
        F.sum("team_passes").alias("team_passes"),
    )


def fill_counts(rows: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F16: every participation row receives counts; zero where it has no event at all."""
    marked = counts.withColumn("_seen", F.lit(True))
    joined = rows.join(marked, list(keys), "left")
    names = [c for c in counts.columns if c not in keys]
    return joined.select(
        *[c for c in rows.columns],
        *[
            F.when(F.col("_seen"), F.col(c)).otherwise(F.lit(0).cast(counts.schema[c].dataType)).alias(c)
            for c in names
        ],
    )


def match_observations(
    events: DataFrame, lineups: DataFrame, ends: DataFrame, with_assists: bool = False
) -> DataFrame:
    """E5-E10 for every line-up row."""
    keys = ["match_id", "player_id"]
    source = link_assists(events) if with_assists else events
    counted = fill_counts(lineups, actor_counts(source, keys, with_assists), keys)
    context = on_pitch_context(match_clock(events, ends), lineups)
    names = [c for c in context.columns if c not in keys]
    joined = counted.join(context.withColumn("_on", F.lit(True)), keys, "left")
    return joined.select(
        *counted.columns,
        *[F.when(F.col("_on"), F.col(c)).otherwise(F.lit(0)).cast("bigint").alias(c) for c in names],
    )


def match_duration(ends: DataFrame, out: str) -> DataFrame:
    """Minutes of a match, null unless its periods are exactly 1-2 or 1-4."""
    last, count = F.max("period"), F.count(F.lit(1))
    whole = (last == count) & last.isin(2, 4)
    return ends.groupBy("match_id").agg(F.when(whole, F.sum("length") / 60).alias(out))


def team_observations(events: DataFrame, ends: DataFrame, with_assists: bool = False) -> DataFrame:
    """The same counts with the team as actor over the true match duration."""
    source = link_assists(events) if with_assists else events
    counts = actor_counts(source, ["match_id", "team_id"], with_assists)
    return counts.join(match_duration(ends, "minutes"), "match_id")


def team_match_context(events: DataFrame, ends: DataFrame) -> DataFrame:
    """Duration, open passes, shots, own and opponent possession sequences."""
    played = events.where(_in_play())
    per_team = played.groupBy("match_id", "team_id").agg(
        F.count_if(_open_pass()).alias("passes"), F.count_if(_shot()).alias("shots")
    )
    sequences = (
        played.where(F.col("possession").isNotNull())
        .select("match_id", "period", "possession", "possession_team")
        .distinct()
        .groupBy("match_id", F.col("possession_team").alias("team_id"))
        .agg(F.count(F.lit(1)).alias("possessions"))
    )
    total = sequences.groupBy("match_id").agg(F.sum("possessions").alias("all_possessions"))
    duration = match_duration(ends, "duration_minutes")
    own = F.coalesce("possessions", F.lit(0))
    return (
        per_team.join(sequences, ["match_id", "team_id"], "left")
        .join(total, "match_id", "left")
        .join(duration, "match_id", "left")
        .select(
            "match_id",
            "team_id",
            "duration_minutes",
            "passes",
            "shots",
            own.alias("possessions"),
            (F.coalesce("all_possessions", F.lit(0)) - own).alias("opponent_possessions"),
        )
    )


# -- shared actions and provider-native counts -----------------------------------

# Pass outcomes of the structured feed that are known failures.
FAILED_PASS = ["Incomplete", "Out", "Pass Offside", "Injury Clearance"]
# Restart subtypes of the tagged feed that are passes.
PASS_RESTARTS = [30, 31, 32, 34, 36]


def structured_actions(events: DataFrame) -> DataFrame:
    """Structured events as shot / pass actions with a three-valued outcome."""
    kind = F.when(_shot(), "shot").when(_is("Pass"), "pass")
    outcome = F.coalesce("outcome", F.lit("Complete"))
    complete = F.when(outcome == "Complete", True).when(outcome.isin(FAILED_PASS), False)
    return events.select("*", kind.alias("action"), complete.alias("complete")).where(
        F.col("action").isNotNull()
    )


def _tag(*codes: int) -> Column:
    tags = F.coalesce("tags", F.array().cast("array<int>"))
    return F.arrays_overlap(tags, F.array(*[F.lit(c) for c in codes]))


def _tag_outcome() -> Column:
    hit, miss = _tag(TAG_ACCURATE), _tag(TAG_INACCURATE)
    return F.when(hit & ~miss, True).when(miss & ~hit, False)


def tagged_actions(events: DataFrame) -> DataFrame:
    """Tagged events (kind, sub, tags) as the same actions."""
    kind, sub = F.col("kind"), F.col("sub")
    action = F.when((kind == 10) | ((kind == 3) & (sub == 33)), "shot").when(
        (kind == 8) | ((kind == 3) & sub.isin(PASS_RESTARTS)), "pass"
    )
    return events.select("*", action.alias("action"), _tag_outcome().alias("complete")).where(
        F.col("action").isNotNull()
    )


def common_counts(actions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nine counts shared by both feeds."""
    is_pass = F.col("action") == "pass"
    located = is_pass & ~_unlocated()
    made = located & F.col("complete")
    return actions.groupBy(*keys).agg(
        count_where(F.col("action") == "shot").alias("c_shots"),
        count_where(is_pass).alias("c_passes"),
        count_where(is_pass & F.col("complete")).alias("c_completed"),
        count_where(is_pass & F.col("complete").isNull()).alias("c_outcome_missing"),
        count_where(is_pass & _unlocated()).alias("c_geometry_missing"),
        count_where(located & (pitch.travelled(*XY) >= 30)).alias("c_long"),
        count_where(made & pitch.progressive_relative(*XY)).alias("c_progressive"),
        count_where(made & pitch.enters_final_third("x", "end_x")).alias("c_final_third"),
        count_where(made & pitch.enters_box(*XY)).alias("c_box"),
    )


def structured_native(events: DataFrame, keys: Sequence[str], unit: str = "match_id") -> DataFrame:
    """Native counts; kinds the whole match lacks are unavailable, not zero."""
    optional = {"pressures": "Pressure", "carries": "Carry", "recoveries": "Ball Recovery"}
    present = events.groupBy(unit).agg(
        *[F.max(_is(kind)).alias(f"_has_{name}") for name, kind in optional.items()]
    )
    opened = _open_pass()
    outcome = F.coalesce("outcome", F.lit("Complete"))
    counted = events.groupBy(*dict.fromkeys([unit, *keys])).agg(
        count_where(opened).alias("open_passes"),
        count_where(opened & (outcome == "Complete")).alias("open_completed"),
        count_where(opened & ~outcome.isin("Complete", *FAILED_PASS)).alias(
            "open_outcome_missing"
        ),
        count_where(_is("Pass") & F.col("is_cross")).alias("crosses"),
        poisoned_sum("xg", _shot(), F.col("xg").isNull()).alias("npxg"),
        *[count_where(_is(kind)).alias(name) for name, kind in optional.items()],
        count_where(_is("Dribble")).alias("dribbles"),
        count_where(_is("Interception")).alias("interceptions"),
        count_where(_is("Duel") & (F.col("subtype") == "Tackle")).alias("tackles"),
    )
    gated = counted.join(present, unit)
    for name in optional:
        gated = gated.withColumn(name, F.when(F.col(f"_has_{name}"), F.col(name)))
    return gated.drop(*[f"_has_{name}" for name in optional])


def tagged_native(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Native counts from kind, subtype and tag predicates."""
    kind, sub = F.col("kind"), F.col("sub")
    hit, miss = _tag(TAG_ACCURATE), _tag(TAG_INACCURATE)
    rules = {
        "open_passes": kind == 8,
        "open_completed": (kind == 8) & hit & ~miss,
        "open_outcome_missing": (kind == 8) & (hit == miss),
        "crosses": (kind == 8) & (sub == 80),
        "key_passes": _tag(TAG_KEY_PASS),
        "duels": kind == 1,
        "attacking_duels": (kind == 1) & (sub == 11),
        "sliding_tackles": _tag(TAG_SLIDING),
        "interceptions": _tag(TAG_INTERCEPTION),
        "accelerations": (kind == 7) & (sub == 70),
        "clearances": (kind == 7) & (sub == 71),
    }
    return events.groupBy(*keys).agg(*[count_where(c).alias(n) for n, c in rules.items()])


DUEL_KINDS = {"aerial_duels": 10, "attacking_duels": 11, "defensive_duels": 12}


def tagged_features(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Native feature counts and the list of features evidence is missing for."""
    kind, sub = F.col("kind"), F.col("sub")
    shot = (kind == 10) | ((kind == 3) & (sub == 33))
    hit, miss = _tag(TAG_ACCURATE), _tag(TAG_INACCURATE)
    is_pass, cross, done, known = kind == 8, sub == 80, hit & ~miss, hit != miss
    located = ~_unlocated()
    start = F.col("x").isNotNull() & F.col("y").isNotNull()
    zone = pitch.progressive_zone(*XY)
    counts = {
        "non_penalty_shots": shot,
        "box_shots": shot & start & pitch.in_box("x", "y"),
        "on_target_shots": shot & _tag(*TAG_GOAL_ZONES) & ~_tag(TAG_BLOCKED),
        "passes": is_pass,
        "crosses": is_pass & cross,
        "key_passes": is_pass & _tag(TAG_KEY_PASS),
        "completed_passes": is_pass & done,
        "completed_crosses": is_pass & cross & done,
        "forward_passes": is_pass & located & (F.col("end_x") > F.col("x")),
        "long_passes": is_pass & located & (pitch.travelled(*XY) >= 30),
        "progressive_passes": is_pass & located & done & zone,
        "final_third_entries": is_pass & located & done & pitch.enters_final_third("x", "end_x"),
        "box_entries": is_pass & located & done & pitch.enters_box(*XY),
        "interceptions": _tag(TAG_INTERCEPTION),
        "sliding_tackles": _tag(TAG_SLIDING),
        "clearances": (kind == 7) & (sub == 71),
        "accelerations": (kind == 7) & (sub == 70),
    }
    no_outcome, no_place = is_pass & ~known, is_pass & ~located
    missing = {
        "box_shots": shot & ~start,
        "completed_passes": no_outcome,
        "pass_completion": no_outcome,
        "completed_crosses": no_outcome & cross,
        "forward_passes": no_place,
        "long_passes": no_place,
        "progressive_passes": no_outcome | no_place,
        "final_third_entries": no_outcome | no_place,
        "box_entries": no_outcome | no_place,
    }
    verdicts = sum(
        (_tag(t).cast("int") for t in (TAG_LOST, TAG_NEUTRAL, TAG_WON)), F.lit(0)
    )
    for name, code in DUEL_KINDS.items():
        duel = (kind == 1) & (sub == code)
        counts[name] = duel
        counts[f"won_{name}"] = duel & _tag(TAG_WON) & ~_tag(TAG_LOST, TAG_NEUTRAL)
        missing[f"won_{name}"] = duel & (verdicts != 1)
    flags = [F.when(F.max(F.coalesce(c, F.lit(False))), F.lit(n)) for n, c in missing.items()]
    return events.groupBy(*keys).agg(
        *[count_where(c).alias(n) for n, c in counts.items()],
        F.array_sort(F.array_compact(F.array(*flags))).alias("unavailable"),
    )


def type_histogram(events: DataFrame, keys: Sequence[str], kind: str = "event_type") -> DataFrame:
    """Rows per event type."""
    return events.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n"))


def match_document(
    events: DataFrame, lineups: DataFrame, names: DataFrame, frames: DataFrame | None = None
) -> DataFrame:
    """One nested document per match: players with counts, bins, types, frames.

    Each part is aggregated before it is nested, so a document holds at most one
    struct per line-up row, cell, type or frame of one match.
    """
    counts = actor_counts(events, ["match_id", "player_id"]).select(
        "match_id", "player_id", "shots", "passes", "completed_passes"
    )
    rows = fill_counts(
        lineups.select("match_id", "player_id", "team_id", "minutes"), counts, ["match_id", "player_id"]
    ).join(names, "player_id", "left")
    players = rows.groupBy("match_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("player_id", "name", "team_id", "minutes", "shots", "passes", "completed_passes")
            )
        ).alias("players")
    )
    types = (
        type_histogram(events, ["match_id"])
        .groupBy("match_id")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "event_type", "n"))),
                lambda s: F.struct(s["event_type"].alias("event_type"), s["n"].alias("n")),
            ).alias("types")
        )
    )
    doc = players.join(types, "match_id", "left").join(
        nested_bins(grid_bins(events, ["match_id"]), ["match_id"]), "match_id", "left"
    )
    if frames is not None:
        # Points without a known player (the ball) stay, without a name.
        named = frames.join(names.withColumnRenamed("player_id", "object_id"), "object_id", "left")
        nested = named.groupBy("match_id", "frame").agg(
            F.array_sort(F.collect_list(F.struct("object_id", "name", "x", "y"))).alias("objects")
        )
        nested = nested.groupBy("match_id").agg(
            F.array_sort(F.collect_list(F.struct("frame", "objects"))).alias("frames")
        )
        doc = doc.join(nested, "match_id", "left")
    return doc
