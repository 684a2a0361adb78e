import random

from turfline.llm.components import components


def brute(edges):
    root = {n: n for e in edges for n in e}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for u, v in edges:
        low, high = sorted((top(u), top(v)))
        root[high] = low
    return {n: top(n) for n in root}


def test_equals_union_find(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    star = [(2000 - i, 2500) for i in range(200)]
    loose = [(rng.randrange(3000, 3300), rng.randrange(3000, 3300)) for _ in range(150)]
    edges = chain + star + [(u, v) for u, v in loose if u != v] + [(1, 2), (2, 1), (1, 2)]
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == brute(edges) and len(got) == len({r.node for r in got})
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
