"""Registered queries: a Spark callable, the SURVEY ids it covers and its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from turfline.plans.views import Views, sql_prefix


@dataclass(frozen=True)
class Entry:
    run: Callable[[Views], DataFrame]
    covers: tuple[str, ...]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None, views: str = ""):
    """Register a query. ``views`` names the derived views the SQL text starts from."""

    def register(fn: Callable[[Views], DataFrame]):
        text = None if sql is None else sql_prefix(views.split(), sql)
        ENTRIES[name] = Entry(fn, tuple(covers.split()), text)
        return fn

    return register
