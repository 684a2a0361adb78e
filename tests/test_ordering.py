import numpy as np
import pytest
from pyspark.sql import functions as F

from turfline.operators import ordering as O


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    data = []
    for g in range(3):
        x = rng.normal(0, 10 ** (g - 1), size=400).round(2)
        x[: 400 // 3] = 0.25  # a third of the rows share one value
        data += [(g, i, float(v)) for i, v in enumerate(x)]
    return data, spark.createDataFrame(data, "g int, id long, v double")


def test_midrank_and_quantiles(values):
    data, df = values
    got = {(r.g, r.id): r.p for r in O.with_midrank(df, ["g"], "v", "p").collect()}
    quant = {r.g: (r.a, r.b, r.c) for r in O.group_quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}).collect()}
    for g in range(3):
        x = np.array([v for h, _, v in data if h == g])
        for h, i, v in data:
            if h == g:
                assert got[g, i] == pytest.approx(100 * ((x < v).sum() + 0.5 * (x == v).sum()) / len(x))
        assert quant[g] == pytest.approx(tuple(np.quantile(x, [0.1, 0.5, 0.99])))


def test_midrank_example(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (1.0,), (2.0,)], "v double").withColumn("g", F.lit(0))
    assert {r.p for r in O.with_midrank(df, ["g"], "v", "p").where("v = 0").collect()} == {25.0}


def test_row_index_splits_ties(values):
    data, df = values
    got = {(r.g, r.id): r.n for r in O.row_index(df, ["g"], "v", "id", "n", parts=16).collect()}
    for g in range(3):
        order = sorted((v, i) for h, i, v in data if h == g)
        assert [got[g, i] for _, i in order] == list(range(1, len(order) + 1))


def test_reference_midrank(values, spark):
    data, df = values
    probes = spark.createDataFrame([(0, -1.0), (0, 0.25), (1, 99.0)], "g int, v double")
    got = {(r.g, r.v): r.p for r in O.with_reference_midrank(probes, df, ["g"], "v", "p").collect()}
    for (g, v), p in got.items():
        x = np.array([w for h, _, w in data if h == g])
        assert p == pytest.approx(100 * ((x < v).sum() + 0.5 * (x == v).sum()) / len(x))


def test_sequence_scan_matches_one_window(spark):
    df = spark.createDataFrame([(i % 2, i, i * 7 % 5) for i in range(60)], "k int, t int, x int")
    out = O.sequence_scan(df, ["k"], F.floor(F.col("t") / 7), ["t"], lag={"p": "x"}, lead={"q": "x"}, running={"s": F.col("x")})
    for k in (0, 1):
        rows = sorted(out.where(F.col("k") == k).collect(), key=lambda r: r.t)
        x = [r.x for r in rows]
        assert [r.p for r in rows] == [None, *x[:-1]]
        assert [r.q for r in rows] == [*x[1:], None]
        assert [r.s for r in rows] == list(np.cumsum(x))


def test_top_k_limits_before_the_shuffle(values):
    _, df = values
    plan = O.top_k(df, ["g"], ["v", "id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
