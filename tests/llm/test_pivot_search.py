import math
import random

import pytest

from turfline.llm import pivot_search as P


def brute(rows, queries, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in good if queries(i)}):
        hits = sorted({(-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q})[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(hits, 1)]
    return out


@pytest.mark.parametrize("kind", ["plain", "ties", "odd"])
def test_equals_brute_force(spark, kind):
    rng = random.Random(kind)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(700)]
    if kind == "ties":
        rows = [(i, [1.0, 0.0, 0.5] if i % 3 else [rng.choice([0.0, 0.25]) for _ in range(3)]) for i in range(900)]
    if kind == "odd":
        rows += [(1000, None), (1001, [None, 1.0]), (1050, [float("nan")] * 6), (1100, [float("inf")] * 6), (1150, []), (None, [1.0] * 6), (1200, [2.0]), (3, rows[3][1])]
    frame = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, block long")
    rows = [(i, list(v) if v is not None else None) for i, v, _ in frame.collect()]
    got = P.top_k(frame, frame.where("vec_id % 50 = 0")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, lambda i: i % 50 == 0, 5))


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "DATA_BLOCK", 16)
    monkeypatch.setattr(P, "QUERY_BLOCK", 4)
    rng = random.Random(9)
    rows = [(i, [rng.gauss(c * 4, 1) for c in (i % 3, i % 2)]) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, P.top_k(frame, frame.where("vec_id % 50 = 0"), 3).collect())) == sorted(brute(rows, lambda i: i % 50 == 0, 3))


def test_few_and_none(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert P.top_k(empty, empty).collect() == []
    two = spark.createDataFrame([(0, [1.0]), (1, [-1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in P.top_k(two, two).orderBy("query_id").collect()] == [(0, 1, 1, -65536), (1, 1, 0, -65536)]
