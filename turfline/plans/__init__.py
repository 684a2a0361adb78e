"""Queries over the given tables, grouped by topic."""

from __future__ import annotations

import importlib
import importlib.util

TOPICS = [
    "counting",
    "profiles",
    "quality",
    "intervals",
    "timesplit",
    "similarity",
    "evaluation",
    "ranking",
    "peers",
    "sweep",
    "capability",
    "report",
    "prediction",
    "resolution",
    "sources",
]


def load_entries():
    from turfline.plans.registry import ENTRIES

    for topic in TOPICS:
        if importlib.util.find_spec(f"turfline.plans.{topic}") is None:
            continue
        importlib.import_module(f"turfline.plans.{topic}")
    return ENTRIES
