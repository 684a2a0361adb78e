import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


@pytest.fixture(scope="session")
def spark():
    from turfline.session import local_session

    session = local_session("8", "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate column expressions on a single row."""

    def run(*columns):
        row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
        return tuple(row)

    return run
