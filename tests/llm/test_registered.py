"""Registered queries against their SQL oracles on the small tables."""

import pytest

import __spark_entry__ as contract
from tools.check import oracle_connection, rows_of
from turfline.llm.registry import load

FOLDER = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    queries = contract.queries()
    for n in range(1, 14):
        assert len([q for q in queries if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in queries and set(load()[1]) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(load()[1]))
def test_equals_oracle(spark, name):
    frame = contract.queries()[name](spark, FOLDER)
    cursor = oracle_connection(FOLDER).execute(load()[1][name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(columns, cursor.fetchall())
