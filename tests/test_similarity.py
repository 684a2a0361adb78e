import numpy as np
import pytest
from pyspark.sql import functions as F

from turfline.operators import evaluation as E
from turfline.operators import scenario as J
from turfline.operators import similarity as S

FAM = {"a": "x", "b": "x", "c": "y"}


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 3)).round(1)
    x[::3] = x[0]  # a third of the rows are copies
    df = spark.createDataFrame([(int(i % 2), i, *map(float, x[i])) for i in range(len(x))], "g int, id long, a double, b double, c double")
    return x, df


def test_ties_by_id(spark):
    rows = spark.createDataFrame([(0, i, [0.0]) for i in ("c", "a", "b")], "g int, id string, vec array<double>")
    got = {}
    for r in S.nearest(rows, ["g"], "id", 2).orderBy("rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == {"c": ["a", "b"], "a": ["b", "c"], "b": ["a", "c"]}


def test_weights_and_explanation(cloud):
    _, df = cloud
    scaler = S.fit_scaling(df, ["g"], FAM, "robust")
    sums = scaler.groupBy("g").agg(F.sum("weight").alias("w")).collect()
    assert all(r.w == pytest.approx(1) for r in sums)
    rows = S.standardise(df, scaler, ["g"], list(FAM))
    pairs = S.nearest(rows, ["g"], "id", 3)
    long = S.explain_pairs(pairs, rows, ["g"], "id", FAM, scaler)
    for r in long.groupBy("id", "neighbour", "distance").agg(F.sum("squared_contribution").alias("s"), F.sum("share").alias("h")).collect():
        assert r.s == pytest.approx(r.distance**2, abs=1e-12)
        assert r.h == pytest.approx(1 if r.distance else 0)


@pytest.mark.parametrize("block", [4096, 32])
def test_blocks_equal_brute_force(cloud, block):
    x, df = cloud
    rows = df.select("g", "id", F.array("a", "b", "c").alias("vec"))
    got = {}
    for r in S.nearest(rows, ["g"], "id", 5, block).orderBy("rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    d2 = sum((x[:, None, k] - x[None, :, k]) ** 2 for k in range(3))
    d = np.sqrt(d2)
    for i in range(len(x)):
        pool = [j for j in range(len(x)) if j % 2 == i % 2 and j != i]
        assert got[i] == sorted(pool, key=lambda j: (d[i, j], j))[:5]


@pytest.mark.parametrize("block", [4096, 40])
def test_counterpart_ranks(cloud, spark, block):
    x, df = cloud
    y = x + np.random.default_rng(6).normal(size=x.shape).round(1)
    first = df.select("g", "id", F.array("a", "b", "c").alias("vec"))
    second = spark.createDataFrame([(int(i % 2), i, y[i].tolist()) for i in range(len(y))], "g int, id long, vec array<double>")
    d = np.sqrt(sum((x[:, None, k] - y[None, :, k]) ** 2 for k in range(3)))
    for r in S.counterpart_ranks(first, second, ["g"], "id", block).collect():
        pool = [j for j in range(len(x)) if j % 2 == r.g]
        own = d[r.id, r.id]
        assert r["rank"] == 1 + sum((d[r.id, j], j) < (own, r.id) for j in pool)
        assert r["candidates"] == len(pool)


def test_family_cosine(cloud):
    _, df = cloud
    rows = df.select("g", "id", F.array("a", "b", "c").alias("z"))
    vec = {r.id: np.array(r.vec) for r in S.cosine_vectors(rows, FAM).collect()}
    z = {r.id: np.array(r.z) for r in rows.collect()}

    def distance(i, j):
        parts = []
        for f in ((0, 1), (2,)):
            u, v = z[i][list(f)], z[j][list(f)]
            n = np.linalg.norm(u), np.linalg.norm(v)
            parts.append(0 if max(n) < 1e-12 else 1 if min(n) < 1e-12 else 1 - u @ v / n[0] / n[1])
        return np.mean(parts)

    for i, j in [(0, 1), (5, 7), (2, 9)]:
        assert ((vec[i] - vec[j]) ** 2).sum() == pytest.approx(distance(i, j), abs=1e-12)


def test_components_match_svd(cloud):
    x, df = cloud
    fitted = S.fit_components(df.select(F.array("a", "b", "c").alias("vec")), []).first()
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(fitted["ratio"], s**2 / (s**2).sum())
    assert np.allclose(np.abs(np.array(fitted["components"])), np.abs(vt))


def test_metrics_examples(spark):
    ranks = spark.createDataFrame([(r,) for r in (1, 2, 6, 11)], "rank int")
    m = E.retrieval_metrics(ranks).first()
    assert (m.recall1, m.recall5, m.recall10) == (0.25, 0.5, 0.75)
    assert m.mrr == pytest.approx(np.mean([1, 1 / 2, 1 / 6, 1 / 11]))
    ties = spark.createDataFrame([(0, 20)], "earlier long, tied long")
    t = E.tie_aware(ties).first()
    assert t.tie_recall5 == 0.25 and t.rr == pytest.approx(sum(1 / k for k in range(1, 21)) / 20)
    j = spark.range(1).select(E.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))).alias("j")).first()
    assert j.j == pytest.approx(1 / 3)


def test_harmonic_expansion_is_continuous(spark):
    a = spark.range(1).select(E.harmonic(F.lit(4096)).alias("a"), E.harmonic(F.lit(4097)).alias("b")).first()
    assert a.b - a.a == pytest.approx(1 / 4097, rel=1e-9)
    got = spark.range(0, 200).select("id", E.harmonic(F.col("id")).alias("h")).collect()
    assert all(r.h == pytest.approx(sum(1 / i for i in range(1, r.id + 1)), abs=1e-13) for r in got)


def test_threshold_choice(spark):
    grid = [(450, 0.18), (600, 0.19), (900, 0.20)]
    data = [(t, p, 10, m) for t, m in grid for p in "pq"] + [(300, "p", 10, 0.9)]
    rows = spark.createDataFrame(data, "threshold int, provider string, queries int, mrr double")
    assert E.select_threshold(rows).first().threshold == 450
    scoped = rows.withColumn("scope", F.when(F.col("threshold") == 450, 1).otherwise(0))
    assert E.select_threshold(scoped, development=[0]).first().threshold == 600
    with pytest.raises(Exception, match="development evidence"):
        E.select_threshold(rows.where("provider = 'p'")).first()


def test_two_group_distance(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=80).round(1), rng.normal(0.5, 2, size=120).round(1)
    rows = spark.createDataFrame([(0, True, float(v)) for v in a] + [(0, False, float(v)) for v in b], "k int, s boolean, v double")
    got = E.two_group_distance(rows, ["k"], F.col("s"), "v").first()
    grid = np.unique(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(np.sort(v), grid, "right") / len(v) for v in (a, b))
    assert got.ks == pytest.approx(np.abs(fa - fb).max())
    assert got.wasserstein == pytest.approx((np.abs(fa - fb)[:-1] * np.diff(grid)).sum())
    assert got.median_a == pytest.approx(np.median(a)) and got.q90_b == pytest.approx(np.quantile(b, 0.9))


@pytest.mark.parametrize("size", [20_000, 30])
def test_pareto_frontier(spark, size):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 12, size=(150, 3)).astype(float)
    x[::5] += 1e-10
    rows = spark.createDataFrame([(0, i, x[i].tolist()) for i in range(len(x))], "s int, id long, losses array<double>")
    got = {r.id for r in J.pareto_frontier(rows, ["s"], "id", size=size).collect()}
    eps = 1e-9
    want = {
        i
        for i in range(len(x))
        if not any(j != i and (x[j] <= x[i] + eps).all() and (x[j] < x[i] - eps).any() for j in range(len(x)))
    }
    assert got == want


def test_pareto_example(spark):
    rows = spark.createDataFrame([(0, "a", [0.0, 2.0]), (0, "b", [2.0, 0.0]), (0, "c", [3.0, 3.0]), (0, "d", [0.0, 2.0])], "s int, id string, losses array<double>")
    assert {r.id for r in J.pareto_frontier(rows, ["s"], "id").collect()} == {"a", "b", "d"}


def test_rank_summary_example(spark):
    ref = spark.createDataFrame([(0, p, i + 1) for i, p in enumerate("abc")], "s int, id string, rank int")
    draws = spark.createDataFrame(
        [(0, d, p, i + 1) for d, order in ((1, "cab"), (2, "abc")) for i, p in enumerate(order)], "s int, draw int, id string, rank int"
    )
    overlaps, rows = J.rank_summary(ref, draws, ["s"], "id", 1, 2)
    assert overlaps.first().mean_jaccard == 0.5
    assert {r.id: r.top_k_inclusion for r in rows.collect()}["a"] == 0.5


@pytest.mark.parametrize("axes", [8, 16, 64])
def test_boxes_leave_blocks_out(spark, axes):
    """With rows in clusters, a small share of the block pairs meets, and no neighbour is lost."""
    rng = np.random.default_rng(axes)
    centres = rng.normal(0, 3, (24, axes))
    points = np.concatenate([c + rng.normal(0, 0.2, (50, axes)) for c in centres])
    rows = spark.createDataFrame([("g", i, p.tolist()) for i, p in enumerate(points)], "g string, id long, vec array<double>")
    blocked = S._with_blocks(rows, ["g"], 50)
    blocks = blocked.select("block").distinct().count()
    met = S._visits(blocked.withColumn("radius", F.lit(0.2 * (2 * axes) ** 0.5)), blocked, ["g"], False).select("block", "target").distinct().count()
    print(f"axes {axes}: {met} of {blocks * (blocks - 1)} block pairs")
    assert met < 0.6 * blocks * (blocks - 1)
    got = sorted((r.id, r.neighbour) for r in S.nearest(rows, ["g"], "id", 3, 50).collect())
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)) + np.diag(np.full(len(points), np.inf))
    assert got == sorted((i, int(j)) for i in range(len(points)) for j in np.argsort(d[i], kind="stable")[:3])
