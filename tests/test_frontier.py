"""Frontiers of unions of groups from the thinned groups, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turfline.operators import scenario as J


@pytest.mark.parametrize("size", [7, 20_000])
def test_thinned_groups_keep_the_frontier_of_their_union(spark, size):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 5, (120, 3)) * 1.0
    x[::9] += 6e-10  # within the tolerance of others
    x[100:] = x[100]  # ties
    rows = spark.createDataFrame([(i % 4, i, p.tolist()) for i, p in enumerate(x)], "club long, id long, losses array<double>")
    few = J.thinned(rows, ["club"], "id", size=size)
    assert few.count() < len(x)
    met = few.withColumn("without", F.explode(F.array(*map(F.lit, range(4))))).where("club <> without")
    got = {(r.without, r.id) for r in J.pareto_frontier(met, ["without"], "id", size=size).collect()}
    beats = lambda a, b: (a <= b + 1e-9).all() and (a < b - 1e-9).any()
    want = {
        (c, i) for c in range(4) for i in range(len(x)) if i % 4 != c and not any(beats(x[j], x[i]) for j in range(len(x)) if j % 4 != c)
    }
    assert got == want
