"""Threshold grid, capability table and report against plain loops on small fixtures."""

import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from turfline.operators import capability as C
from turfline.operators import report as R
from turfline.operators import sweep as M

FAMILIES = {"a": "x", "b": "x", "c": "y"}
FULL = "league string, player long, primary_role string, minutes double, a double, b double, c double"
HALF = "player long, half int, minutes double, a double, b double, c double"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    full, halves = [], []
    for i in range(90):
        league, role = ("L1" if i % 3 else "L2"), ("CB", "ST")[i % 2]
        base = [draw.gauss(0, 3) for _ in FAMILIES]
        minutes = 120.0 + draw.randrange(400)
        values = [round(x + draw.gauss(0, 0.5), 1) for x in base]
        if i % 29 == 0:
            values[1] = None
        full.append((league, i, role, minutes, *values))
        for half in (0, 1):
            halves.append((i, half, minutes * (0.3 if half else 0.7), *[round(x + draw.gauss(0, 0.6), 1) for x in base]))
    # Unknown role, goalkeeper, equal rows, one half only, and a league of one eligible player.
    full += [("L1", 100, None, 900.0, 1.0, 1.0, 1.0), ("L1", 101, "GK", 900.0, 1.0, 1.0, 1.0), ("L3", 102, "CB", 900.0, 1.0, 1.0, 1.0)]
    full += [("L4", 110 + i, "CB", 900.0, 1.0, 1.0, 1.0) for i in range(3)] + [("L4", 113, "CB", 900.0, 1.0, 1.0, 1.0)]
    halves += [(p, h, 450.0, 1.0, 1.0, 1.0) for p in (102, 110, 111, 112) for h in (0, 1)] + [(113, 0, 900.0, 1.0, 1.0, 1.0)]
    return full, halves


def grid_of(spark, rows):
    full, halves = spark.createDataFrame(rows[0], FULL), spark.createDataFrame(rows[1], HALF)
    eligible = C.eligible_profiles(full, (200, 400), list(FAMILIES))
    pairs = C.eligible_pairs(eligible, halves, ["league"], "player", list(FAMILIES))
    return eligible, C.threshold_grid(eligible, pairs, ["league"], "player", FAMILIES, draws=10, minimum_pairs=10)


def by_hand(rows, league, threshold, role):
    full = [r for r in rows[0] if r[0] == league and r[2] == role and r[3] >= threshold and None not in r[4:]]
    half = {(r[0], r[1]): r for r in rows[1] if None not in r[3:]}
    both = [r[1] for r in full if all((r[1], h) in half and half[r[1], h][2] >= threshold / 2 for h in (0, 1))]
    if len(both) < 2:
        return len(full), len(both), None
    side = [[half[p, h][3:] for p in both] for h in (0, 1)]
    sd = [statistics.pstdev(col) for col in zip(*side[0], strict=True)]
    live = [i for i, s in enumerate(sd) if s > 1e-10]
    names = list(FAMILIES.values())
    weight = {i: 1 / (len({names[j] for j in live}) * sum(names[j] == names[i] for j in live)) for i in live}
    rr = []
    for i, x in enumerate(side[0]):
        d = [math.sqrt(sum(weight[f] * ((x[f] - y[f]) / sd[f]) ** 2 for f in live)) for y in side[1]]
        tied = sum(abs(y - d[i]) <= 1e-10 for y in d)
        before = sum(y < d[i] - 1e-10 for y in d)
        rr.append(statistics.mean(1 / k for k in range(before + 1, before + tied + 1)))
    return len(full), len(both), statistics.mean(rr)


def test_grid_equals_plain_loops(spark, rows):
    eligible, table = grid_of(spark, rows)
    found = {(r.league, r.threshold, r.primary_role): r for r in table.collect()}
    cells = itertools.product(("L1", "L2", "L3", "L4"), (200.0, 400.0), ("CB", "ST"))
    wanted = {cell: by_hand(rows, *cell) for cell in cells}
    assert set(found) == {cell for cell, w in wanted.items() if w[0]}
    for cell, row in found.items():
        profiles, queries, mrr = wanted[cell]
        assert (row.eligible_profiles, row.queries) == (profiles, queries), cell
        assert row.mrr == (mrr if mrr is None else pytest.approx(mrr, abs=1e-9)), cell
        if queries < 2:
            assert row.reasons == ["insufficient_pairs"] and not row.passed and row.random_mrr is None
        else:
            assert row.mrr_low - 1e-9 <= row.mrr_high and row.passed == (row.reasons == [])
    # Equal rows tie in full: the mean place of three, and no feature varies.
    tie = found["L4", 200.0, "CB"]
    assert tie.mrr == pytest.approx((1 + 1 / 2 + 1 / 3) / 3) and tie.nonconstant_features == 0 and tie.median_spearman is None


def test_empty_grid(spark):
    _, table = grid_of(spark, ([], []))
    assert table.count() == 0


def test_capability_of_every_scope(spark):
    grid = spark.createDataFrame(
        [("A", 200.0, "CB", 9, True), ("A", 200.0, "ST", 8, True), ("A", 200.0, "W", 5, False), ("A", 100.0, "CB", 20, True), ("B", 200.0, "CB", 9, False)],
        "league string, threshold double, primary_role string, eligible_profiles long, passed boolean",
    )
    chosen = spark.createDataFrame([("A", 200.0, ["CB", "ST"]), ("B", None, [])], "league string, threshold double, roles array<string>")
    eligible = spark.createDataFrame(
        [("A", 200.0, "CB", 1), ("A", 200.0, "CB", 2), ("A", 200.0, "ST", 3), ("A", 200.0, "W", 4), ("A", 100.0, "CB", 5)],
        "league string, threshold double, primary_role string, player long",
    )
    minutes = spark.createDataFrame(
        [("A", 1, 7, 90.0), ("A", 2, 7, 300.0), ("A", 2, 8, 89.0), ("A", 3, 8, 500.0), ("A", 4, 8, 500.0), ("A", 5, 8, 500.0)],
        "league string, player long, team_id long, minutes double",
    )
    clubs = C.club_roles(eligible, chosen, minutes, ["league"], "player")
    assert sorted(map(tuple, clubs.collect())) == [("A", 7, "CB", 2, True), ("A", 8, "ST", 1, False)]
    scopes = spark.createDataFrame([("A", 6, 3, 50), ("B", 5, 3, 10), ("C", 2, 2, None)], "league string, matches long, teams long, profiles long")
    found = {r.league: r for r in C.capability_table(scopes, grid, chosen, clubs, ["league"]).collect()}
    assert (found["A"].threshold, found["A"].roles, found["A"].eligible_profiles, found["A"].enabled_clubs) == (200.0, ["CB", "ST"], 17, 1)
    assert found["A"].recruitment_enabled and found["A"].coverage_status == "complete" and found["A"].reason == "registered_league_role_gates_passed"
    assert not found["B"].recruitment_enabled and found["B"].reason == "registered_gates_not_met" and found["B"].coverage_status == "partial"
    assert not found["C"].recruitment_enabled and found["C"].reason == "no_registered_evaluation" and found["C"].roles == []
    strict = C.capability_table(scopes.withColumn("matches", F.col("matches") + 1), grid, chosen, clubs, ["league"], require_coverage=True)
    assert not any(r.recruitment_enabled for r in strict.collect())
    assert {r.reason for r in strict.where("league = 'A'").collect()} == {"season_coverage_incomplete"}


def test_neighbour_report_counts_overlaps(spark):
    draw = random.Random(3)
    players = [(p, ("CB", "ST")[p % 2], [draw.gauss(0, 1) for _ in FAMILIES]) for p in range(40)]
    data = [(d, 300, r, p, *[x + d * draw.gauss(0, 0.4) for x in v]) for d in range(3) for p, r, v in players]
    rows = spark.createDataFrame(data, "draw int, threshold int, primary_role string, player long, a double, b double, c double")
    arms = {"euclidean": M.Arm(), "naive_features": M.Arm(balanced=False)}
    vectors = R.arm_vectors(rows, rows, ["draw", "threshold", "primary_role"], ["draw", "threshold"], "player", arms, FAMILIES, list(FAMILIES)).cache()
    minutes = spark.createDataFrame([(p, float(p)) for p, _, _ in players], "player long, minutes double")
    found = {(r.method, r.primary_role): r for r in R.neighbour_report(vectors, minutes, "threshold", "primary_role", "player", k=4).collect()}
    where = {}
    for r in vectors.collect():
        where.setdefault((r.method, r.draw, r.primary_role), {})[r.player] = r.vec
    top = {
        (key, p): {o for _, o in sorted((math.dist(v, w), o) for o, w in vs.items() if o != p)[:4]}
        for key, vs in where.items() for p, v in vs.items()
    }
    share = lambda x, y: len(x & y) / len(x | y)
    for method in ("euclidean", "naive_features", "cosine"):
        for role in ("CB", "ST"):
            ids = where[method, 0, role]
            stable = statistics.mean(share(top[(method, 0, role), p], top[(method, d, role), p]) for p in ids for d in (1, 2))
            same = statistics.mean(share(top[("euclidean", 0, role), p], top[(method, 0, role), p]) for p in ids)
            row = found[method, role]
            assert row.profiles == 20 and row.bootstrap_jaccard == pytest.approx(stable) and row.baseline_overlap == pytest.approx(same)
        assert found[method, None].profiles == 40 and -1 <= found[method, None].minutes_spearman <= 1
    assert found["euclidean", None].baseline_overlap == 1.0
