"""Leakage-safe splits, stints, transitions and trailing context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.functions.constants import ADJACENT_ROLES
from turfline.functions.measures import digest_fold, reason_list
from turfline.operators.ordering import row_index, sequence_scan, value_ladder


def month_of(date: str | Column) -> Column:
    """Chunk of a date for sequence scans."""
    date = F.col(date) if isinstance(date, str) else date
    return F.year(date) * 12 + F.month(date)


def median_match_date(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """G1: date of the middle match (position n // 2), each match counted once."""
    matches = rows.groupBy(*keys, "match_id").agg(F.max("observed_on").alias("d"))
    days = value_ladder(matches.withColumn("day", F.unix_date("d")), keys, "day")
    middle = F.floor(F.col("n_total") / 2)
    hit = (F.col("n_below") <= middle) & (middle < F.col("n_below") + F.col("n"))
    return days.where(hit).select(*keys, F.date_from_unix_date(F.col("day").cast("int")).alias("cutoff"))


def median_split(rows: DataFrame) -> DataFrame:
    """G1: label observations ``first`` (before the cutoff) or ``second``."""
    cutoff = median_match_date(rows)  # always one row
    return rows.join(F.broadcast(cutoff)).withColumn(
        "window", F.when(F.col("observed_on") < F.col("cutoff"), "first").otherwise("second")
    )


def window_exclusions(
    profiles: DataFrame, key: str, threshold: float, reasons: Column
) -> DataFrame:
    """G1: pair both windows of a player and say why a pair is not used.

    ``profiles`` has one row per (key, window) with minutes and primary_role.
    """
    judged = profiles.withColumn("_bad", F.size(reasons) > 0)
    paired = judged.groupBy(key).agg(
        F.count(F.lit(1)).alias("windows"),
        F.max("_bad").alias("bad"),
        F.max(F.when(F.col("window") == "first", F.col("primary_role"))).alias("role_first"),
        F.max(F.when(F.col("window") == "second", F.col("primary_role"))).alias("role_second"),
    )
    reason = (
        F.when(F.col("windows") < 2, "absent_window")
        .when(F.col("bad"), "window_eligibility")
        .when(F.col("role_first") != F.col("role_second"), "role_change")
    )
    return paired.select(key, "role_first", "role_second", reason.alias("exclusion"))


def scoped_match_split(rows: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Chronological halves of each scope's matches (by match, then joined back)."""
    matches = rows.groupBy(*scope, "match_id").agg(F.min("observed_on").alias("d"))
    days = matches.withColumn("day", F.unix_date("d"))
    placed = row_index(days, scope, "day", "match_id", "place")
    totals = placed.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"))
    half = F.when(F.col("place") <= F.floor(F.col("n") / 2), "first").otherwise("second")
    return placed.join(totals, list(scope)).select(*scope, "match_id", half.alias("half"))


def alternating_split(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column
) -> DataFrame:
    """Odd and even appearances of each player, in order."""
    counted = sequence_scan(rows, keys, chunk, order, running={"place": F.lit(1)})
    return counted.withColumn("half", ((F.col("place") - 1) % 2).cast("int"))


def hash_folds(rows: DataFrame, key: str, folds: int = 5, prefix: str = "") -> DataFrame:
    """Stable fold of each key."""
    return rows.withColumn("fold", digest_fold(F.col(key), folds, prefix))


def trailing_context(
    rows: DataFrame, probes: DataFrame, key: str, date: str, cutoff: str, sums: Sequence[str],
    days: int = 365, minimum: int = 3,
) -> DataFrame:
    """Sums of the last ``days`` days up to each probe's cutoff, both inclusive.

    Rows of a key are merged per day, then cumulative sums per (key, day) are
    looked up at both ends of the window; no row meets every probe, so a hot key
    costs its days, not its pairs.
    """
    names = ["_rows", *sums]
    daily = rows.where(F.col(date).isNotNull()).groupBy(key, F.col(date).alias("_day")).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(c) for c in sums]
    )
    ends = probes.select(key, cutoff).distinct()
    marks = ends.select(
        key, F.explode(F.array(F.date_sub(cutoff, days + 1), F.col(cutoff))).alias("_day")
    ).distinct()
    zero = [F.lit(0).alias("_rows"), *[F.lit(0.0).alias(c) for c in sums]]
    line = daily.select(key, "_day", *[F.col(c).cast("double").alias(c) for c in names]).unionByName(
        marks.select(key, "_day", *[z.cast("double").alias(n) for z, n in zip(zero, names)])
    )
    merged = line.groupBy(key, "_day").agg(
        *[F.sum(c).alias(c) for c in names],
        F.min(F.when(F.col("_rows") > 0, F.col("_day"))).alias("_seen"),
    )
    along = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy("_day").rowsBetween(1, Window.unboundedFollowing)
    running = merged.select(
        key,
        "_day",
        *[F.sum(c).over(along).alias(c) for c in names],
        F.max("_seen").over(along).alias("_last"),
        F.min("_seen").over(ahead).alias("_next"),
    )
    high = running.select(
        key, F.col("_day").alias(cutoff), F.col("_last").alias("last_date"),
        *[F.col(c).alias(f"_h{c}") for c in names],
    )
    low = running.select(
        key, F.date_add("_day", days + 1).alias(cutoff), F.col("_next").alias("first_date"),
        *[F.col(c).alias(f"_l{c}") for c in names],
    )
    window = (
        ends.join(high, [key, cutoff])
        .join(low, [key, cutoff])
        .select(
            key,
            cutoff,
            (F.col("_h_rows") - F.col("_l_rows")).cast("bigint").alias("matches"),
            "first_date",
            "last_date",
            *[(F.col(f"_h{c}") - F.col(f"_l{c}")).alias(c) for c in sums],
        )
        .where(F.col("matches") >= minimum)
    )
    return probes.join(window, [key, cutoff], "left")


def stints(
    rows: DataFrame, keys: Sequence[str], team: str, order: Sequence[str], chunk: Column
) -> DataFrame:
    """Number consecutive rows with the same team; a return opens a new stint."""
    moved = sequence_scan(rows, keys, chunk, order, lag={"_prev": team})
    change = F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col(team)), 1).otherwise(0)
    flagged = moved.withColumn("_change", change)
    return sequence_scan(
        flagged, keys, chunk, order, running={"stint": F.col("_change")}
    ).drop("_prev", "_change")


def environments(
    numbered: DataFrame, keys: Sequence[str], team: str, counts: Sequence[str], carry: Sequence[str]
) -> DataFrame:
    """Facts per stint: dates, exposure and all-or-null counts of reliable rows."""
    used = F.col("reliable") & (F.col("minutes") > 0)
    n = F.count_if(used)

    def total(c: str) -> Column:
        have = F.count_if(used & F.col(c).isNotNull())
        return F.when((n > 0) & (have == n), F.sum(F.when(used, F.col(c))))

    return numbered.groupBy(*keys, "stint").agg(
        F.min(team).alias("team_id"),
        F.min("observed_on").alias("start_date"),
        F.max("observed_on").alias("end_date"),
        F.count(F.lit(1)).alias("appearances"),
        F.coalesce(F.sum(F.when(used, F.col("minutes"))), F.lit(0.0)).alias("minutes"),
        F.min("reliable").alias("reliable"),
        *[F.min(c).alias(c) for c in carry],
        *[total(c).alias(c) for c in counts],
    )


def role_change(source: Column, destination: Column) -> Column:
    """Same, adjacent, major or unknown."""
    pair = F.array_join(F.array_sort(F.array(source, destination)), "|")
    adjacent = ["|".join(sorted(p)) for p in ADJACENT_ROLES]
    return (
        F.when(source.isNull() | destination.isNull() | (source == "") | (destination == ""), "unknown")
        .when(source == destination, "same")
        .when(pair.isin(adjacent), "adjacent")
        .otherwise("major")
    )


def adjacent_transitions(
    env: DataFrame, keys: Sequence[str], max_gap_days: int = 450
) -> DataFrame:
    """Pair each environment with the player's next one, classified with reasons.

    env: environment_id, team_id, competition_id, season_id, season_start_year,
    start_date, end_date, role, country, quarantined.
    """
    facts = [
        "environment_id", "team_id", "competition_id", "season_id", "season_start_year",
        "start_date", "end_date", "role", "country", "quarantined",
    ]
    packed = env.withColumn("env", F.struct(*facts))
    ordered = sequence_scan(
        packed, keys, month_of("start_date"), ["start_date", "end_date", "environment_id"],
        lead={"next": "env"},
    ).where(F.col("next").isNotNull())
    a, b = F.col("env"), F.col("next")
    gap = F.datediff(b["start_date"], a["end_date"])
    team = a["team_id"] != b["team_id"]
    competition = a["competition_id"] != b["competition_id"]
    same_season = a["season_id"] == b["season_id"]
    kind = (
        F.when(competition & team, "cross_league_change")
        .when(competition, "competition_context_change")
        .when(team & same_season, "same_league_team_change")
        .when(team, "team_and_season_change")
        .otherwise("season_change_same_team")
    )
    reasons = reason_list(
        (gap <= 0, "overlapping_observations"),
        (gap > max_gap_days, f"observation_gap_over_{max_gap_days}_days"),
        (b["season_start_year"] - a["season_start_year"] > 1, "unobserved_intervening_season"),
        (a["quarantined"] | b["quarantined"], "rejected_identity"),
        (~team & ~competition & same_season, "same_environment"),
    )
    return ordered.select(
        *keys,
        a["environment_id"].alias("source_environment_id"),
        b["environment_id"].alias("destination_environment_id"),
        a["end_date"].alias("source_end"),
        b["start_date"].alias("destination_start"),
        gap.alias("gap_days"),
        kind.alias("transition_type"),
        team.alias("actual_team_change"),
        (a["country"] != b["country"]).alias("cross_country_change"),
        a["competition_id"].alias("source_competition"),
        b["competition_id"].alias("destination_competition"),
        role_change(a["role"], b["role"]).alias("role_change"),
        reasons.alias("exclusion_reasons"),
        (F.size(reasons) == 0).alias("structurally_eligible"),
    )


def transition_eligibility(pairs: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Per threshold, structural reasons plus exposure and role reasons."""
    at = pairs.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    reasons = F.concat(
        F.col("exclusion_reasons"),
        reason_list(
            (F.col("source_minutes") < F.col("threshold"), "source_below_minutes"),
            (F.col("destination_minutes") < F.col("threshold"), "destination_below_minutes"),
            (F.col("role_change") == "unknown", "uncertain_role"),
        ),
    )
    return at.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)


def evidence_matrix(judged: DataFrame) -> DataFrame:
    """Episodes and distinct players per threshold, source and destination."""
    keys = ["threshold", "source_competition", "destination_competition"]
    players = judged.where("eligible").groupBy(*keys, "player_id").agg(F.count(F.lit(1)).alias("e"))
    return players.groupBy(*keys).agg(
        F.sum("e").alias("episodes"), F.count(F.lit(1)).alias("players")
    )


def digest_partition(units: DataFrame, key: str, development: int, prefix: str = "") -> DataFrame:
    """The first ``development`` units by SHA-256 order are for development.

    The order is global, so the units are a small dimension (clubs of a league).
    """
    digest = F.sha2(F.concat(F.lit(prefix), F.col(key).cast("string")), 256)
    chosen = (
        units.select(key).distinct().withColumn("digest", digest).orderBy("digest").limit(development)
    )
    return (
        units.select(key)
        .distinct()
        .join(chosen.select(key, F.lit(True).alias("_dev")), key, "left")
        .select(key, F.when(F.col("_dev"), "development").otherwise("final").alias("part"))
    )


def episode_split(
    episodes: DataFrame, test_from: int, prefix: str, folds: int = 5
) -> DataFrame:
    """Test by destination season, validation by hashed player, the rest train."""
    held = digest_fold(F.col("player_id"), folds, prefix) == 0
    part = (
        F.when(F.col("destination_season") >= test_from, "test")
        .when(held, "validation")
        .otherwise("train")
    )
    return episodes.withColumn("part", part)


def split_leaks(episodes: DataFrame, version: str) -> DataFrame:
    """G5 assertions, one row of counts: episodes whose dates overlap, episodes with a side
    of another feature version than ``version`` (an unknown one counts), and players that
    stand in train and in validation."""
    shared = (
        episodes.where(F.col("part").isin("train", "validation"))
        .groupBy("player_id")
        .agg(F.min("part").alias("a"), F.max("part").alias("b"))
        .agg(F.count_if(F.col("a") != F.col("b")).alias("shared_players"))
    )
    same = F.col("source_version").eqNullSafe(version) & F.col("destination_version").eqNullSafe(version)
    rows = episodes.agg(
        F.count_if(F.col("source_end") >= F.col("destination_start")).alias("overlapping_dates"),
        F.count_if(~same).alias("mixed_versions"),
    )
    return rows.join(shared)


def leakage_checked(episodes: DataFrame, version: str) -> DataFrame:
    """Every episode with the assertions it breaks; only rows without any may be split."""
    same = F.col("source_version").eqNullSafe(version) & F.col("destination_version").eqNullSafe(version)
    return episodes.withColumn(
        "broken",
        reason_list(
            (~same, "feature_version"),
            (F.coalesce(F.col("source_end") >= F.col("destination_start"), F.lit(True)), "overlapping_dates"),
        ),
    )
