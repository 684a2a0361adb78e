"""Queries of this subpackage: name, callable over (spark, folder) and SQL oracle if any."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = [
    "quality_classifier",
    "token_ans",
    "secret_guess_cost",
    "disclosure",
    "attention_lm",
    "circulant_minhash",
    "jump_shards",
    "pivot_search",
    "water_filling",
    "template_leaks",
    "importance_resampling",
    "lexical_search",
    "chat_tree",
]


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """(queries, oracles) of every operator module."""
    queries, oracles = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"turfline.llm.{name}")
        queries[module.QUERY] = module.query
        if module.ORACLE_SQL is not None:
            oracles[module.QUERY] = module.ORACLE_SQL
    return queries, oracles
