"""Every registered query runs; those with SQL equal the oracle on the same tables."""

import os

import pytest

import __spark_entry__ as contract
from tools.check import compare, oracle_connection
from turfline.plans import load_entries

FOLDER = os.environ.get("CHECK_DIR", "/root/testdata/sf0.001")
# The default run covers one query per topic; CHECK_ALL=1 covers all of them.
QUICK = [
    "player_match_mart", "style_counts", "team_context_percentile", "scoped_profiles", "dq_order", "dq_foreign_keys",
    "stints", "trailing_context", "alternating_split", "knn_topk", "distribution_shift", "pareto_frontier",
    "loo_context", "change_description", "fixture_sheets", "resolve_names", "facet_search", "tagged_events", "file_audit",
    "roster_holdout_ranks", "frontier_inclusion", "fixed_scaler_stability", "capability_table",
]
NAMES = list(load_entries()) if os.environ.get("CHECK_ALL") else QUICK


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, oracle, name):
    note, _, ok = compare(spark, oracle, FOLDER, name, load_entries()[name])
    assert ok, note


def test_contract(spark):
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150
    assert contract.entry(spark).count() > 0
