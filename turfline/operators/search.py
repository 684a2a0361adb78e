"""Lookup and search over profiles, clubs and fixtures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline.functions.text import normalise_name
from turfline.operators.ordering import top_k


def page(df: DataFrame, order: Sequence[str | Column], limit: int, offset: int = 0, **equals) -> DataFrame:
    """M1: filtered page in a fixed order."""
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df.orderBy(*order).offset(offset).limit(limit)


def search_text(df: DataFrame, parts: Sequence[str], out: str = "search_text") -> DataFrame:
    """M3: normalised search text of a row."""
    return df.withColumn(out, normalise_name(F.concat_ws(" ", *[F.col(p).cast("string") for p in parts])))


def has_all_tokens(query: str, text: str = "search_text") -> Column:
    """Every token of the normalised query occurs in the text."""
    tokens = F.split(normalise_name(F.lit(query)), " ")
    return F.forall(tokens, lambda t: F.col(text).contains(t))


def facet_search(
    df: DataFrame, query: str | None = None, minimum_minutes: float | None = None,
    capabilities: Sequence[str] = (), contains: dict[str, object] | None = None, **equals,
) -> DataFrame:
    """M2/M5: conjunction of facets; equality filters reach the scan."""
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    if minimum_minutes is not None:
        df = df.where(F.col("minutes") >= minimum_minutes)
    for flag in capabilities:
        df = df.where(F.col(flag))
    for name, value in (contains or {}).items():
        df = df.where(F.array_contains(name, value))
    return df.where(has_all_tokens(query)) if query else df


def federated_hits(kinds: dict[str, tuple[DataFrame, int]], query: str) -> DataFrame:
    """M4: best hits of every kind (label, search_text) in one list."""
    parts = None
    for kind, (df, limit) in kinds.items():
        hit = (
            df.where(has_all_tokens(query))
            .orderBy("label")
            .limit(limit)
            .select(F.lit(kind).alias("kind"), "label")
        )
        parts = hit if parts is None else parts.unionByName(hit)
    return parts


def supported_prediction(predictions: DataFrame, **keys) -> DataFrame:
    """M6: one prediction by its keys; reading an unsupported one raises."""
    for name, value in keys.items():
        predictions = predictions.where(F.col(name) == value)
    ok = F.when(F.col("status") == "supported", F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("unsupported prediction: "), F.col("status"))).isNotNull()
    )
    return predictions.where(ok)


def best_neighbours(neighbours: DataFrame, ident: str, value, n: int) -> DataFrame:
    """M7: first neighbours of one profile."""
    return neighbours.where((F.col(ident) == value) & (F.col("rank") <= n)).orderBy("rank")


def style_features(long: DataFrame, ident: str, per_family: int = 2, total: int = 10) -> DataFrame:
    """M8: the first features of every family, ``total`` at most per profile."""
    some = top_k(long, [ident, "family"], [F.desc("percentile"), "feature"], per_family, "_place")
    return top_k(some, [ident], ["family", "_place"], total, "place").drop("_place")


def match_players(players: DataFrame, name: str | None = None, team=None) -> DataFrame:
    """M9: players of a match by team and accent-free part of their name."""
    if team is not None:
        players = players.where(F.col("team_id") == team)
    if name:
        players = players.where(normalise_name("name").contains(normalise_name(F.lit(name))))
    return players


def club_fixtures(fixtures: DataFrame, club, limit: int = 80) -> DataFrame:
    """Fixtures of one club, capped for display."""
    own = (F.col("home") == club) | (F.col("away") == club)
    return fixtures.where(own).orderBy("date", "fixture_id").limit(limit)
