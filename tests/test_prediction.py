import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from turfline.operators import prediction as K
from turfline.operators import resolution as L
from turfline.operators import timesplit as G


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) * [1, 5, 0.1]
    y = x @ [1.0, -0.3, 4.0] + 8 + rng.normal(size=60)
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    got = np.array([r.point for r in K.fit_ridge(rows, ["a", "b", "c"], "y", 10.0)(rows).select("point").collect()])
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(got, np.maximum(0, z @ w + y.mean()), atol=1e-8)


def test_predictive_quantiles_need_no_pairs(spark):
    rng = np.random.default_rng(4)
    res, points = rng.normal(size=37), np.array([0.1, 0.5, 3.0])
    residuals = spark.createDataFrame([(float(r),) for r in res], "residual double")
    rows = spark.createDataFrame([(float(p),) for p in points], "point double")
    for r in K.with_quantiles(rows, residuals, K.interval_probs()).collect():
        draws = np.maximum(0, r.point + res)
        for name, p in K.interval_probs().items():
            assert r[name] == pytest.approx(np.quantile(draws, p))


def test_trailing_context_ignores_the_future(spark):
    day = dt.date(2020, 1, 1)
    rows = [("t", day + dt.timedelta(days=i), 400.0, 90.0) for i in (0, 100, 365)] + [("t", day + dt.timedelta(days=366), 1e6, 90.0)]
    table = spark.createDataFrame(rows, "team string, d date, passes double, minutes double")
    probes = spark.createDataFrame([("t", day + dt.timedelta(days=365)), ("u", day)], "team string, cutoff date")
    got = {r.team: r for r in G.trailing_context(table, probes, "team", "d", "cutoff", ["passes", "minutes"]).collect()}
    assert got["t"].matches == 3 and 90 * got["t"].passes / got["t"].minutes == 400
    assert got["t"].first_date == day and got["u"].matches is None


def test_transitions(spark):
    d = dt.date
    rows = [
        ("p", "e1", "a", "l", "s1", 2018, d(2018, 8, 1), d(2018, 12, 1), "CB", "x", False),
        ("p", "e2", "b", "l", "s1", 2018, d(2019, 1, 1), d(2019, 5, 1), "DM", "x", False),
        ("p", "e3", "c", "l", "s2", 2019, d(2020, 9, 1), d(2020, 10, 1), "ST", "x", False),
    ]
    env = spark.createDataFrame(
        rows,
        "player_id string, environment_id string, team_id string, competition_id string, season_id string, season_start_year int,"
        " start_date date, end_date date, role string, country string, quarantined boolean",
    )
    got = {r.source_environment_id: r for r in G.adjacent_transitions(env, ["player_id"]).collect()}
    assert got["e1"].transition_type == "same_league_team_change" and got["e1"].role_change == "adjacent"
    assert got["e2"].transition_type == "team_and_season_change" and got["e2"].role_change == "major"
    assert got["e2"].exclusion_reasons == ["observation_gap_over_450_days"] and got["e1"].structurally_eligible


def test_sheets(spark):
    def lines(text):
        return spark.createDataFrame([("f", "n", i + 1, t) for i, t in enumerate(text)], "file string, nation string, line long, raw string")

    clubs, bad = L.parse_clubs(lines(["| lost", "= head", "FC Óne, 1900, @ Park, x # c", "  | One | Uno", "@ nowhere", "|Eins"]))
    row = clubs.first()
    assert (row.name, row.aliases, row.stadium, row.source_line) == ("FC Óne", ["One", "Uno", "Eins"], "Park", 3)
    assert {(r.line, r.reason) for r in bad.collect()} == {(1, "alias_without_club"), (5, "unrecognized_club_row")}
    players, bad = L.parse_players(lines(["Ana B, MF, 1.75 m, b. 10 Nov 2002, Town", "X, ZZ, -, -", "Cy D, G|DF, -, b. 1 Sept 1999"]))
    got = {r.name: r for r in players.collect()}
    assert got["Ana B"].dob == dt.date(2002, 11, 10) and got["Ana B"].height_m == 1.75
    assert got["Cy D"].dob == dt.date(1999, 9, 1) and bad.first().line == 2
    games, bad = L.parse_fixtures(
        lines(["▪ Round 1", "Sat Aug 12", "15:30  A  2-1 (1-0)  B", "C v D  3:0", "[Sun 13]", "E v F [postponed]", "1:2 odd"])
    )
    got = {r.home: r for r in games.collect()}
    assert got["A"].score == [2, 1] and got["A"].time == "15:30" and got["A"].date_text == "Sat Aug 12"
    assert got["C"].score == [3, 0] and got["C"].away == "D" and got["C"].round == "Round 1"
    assert got["E"].away == "F" and got["E"].score_note == "[postponed]" and got["E"].date_text == "[Sun 13]"
    assert bad.first().line == 7


def test_role_change_is_symmetric(one):
    assert one(
        G.role_change(F.lit("W"), F.lit("FB/WB")), G.role_change(F.lit("FB/WB"), F.lit("W")),
        G.role_change(F.lit("GK"), F.lit("ST")), G.role_change(F.lit(None).cast("string"), F.lit("ST")),
    ) == ("adjacent", "adjacent", "major", "unknown")


def test_poisson_gradient_vanishes(spark):
    """At the answer the penalised likelihood has no slope (penalty on standardised weights)."""
    rng = np.random.default_rng(6)
    x, minutes = rng.normal(size=(200, 2)), rng.uniform(100, 900, 200)
    counts = rng.poisson(minutes / 90 * np.exp(0.3 * x[:, 0] - 0.2 * x[:, 1]))
    rows = spark.createDataFrame(
        [(float(a), float(b), float(m), float(c)) for (a, b), m, c in zip(x, minutes, counts)], "a double, b double, m double, c double"
    )
    fitted = K.fit_poisson(rows, ["a", "b"], "c", "m")(rows).collect()
    expected, y = np.array([r.expected for r in fitted]), np.array([r.c for r in fitted])
    assert abs((y - expected).sum()) < 1e-4 * y.sum()
    design = np.array([[r.a, r.b] for r in fitted])
    rate = np.log(expected / np.array([r.m for r in fitted]))
    weights = np.linalg.lstsq(np.column_stack([design, np.ones(200)]), rate, rcond=None)[0][:2]
    slope = design.T @ (y - expected) / expected.sum()
    assert np.allclose(slope, 0.01 * weights * design.var(0, ddof=1), atol=3e-4) and np.allclose(weights, [0.3, -0.2], atol=0.1)


def test_method_gates(spark):
    def chosen(mae, coverage, width):
        table = [("ridge", mae, coverage, width), ("role_mean", 1.0, 0.8, 2.0), ("unchanged_source", 1.2, 0.8, 1.0)]
        rows = spark.createDataFrame(table, "method string, mae double, coverage80 double, width80 double")
        row = K.choose_method(rows, "ridge").first()
        return row.method, sorted(row.reasons)

    assert chosen(1.09, 0.8, 2.9) == ("ridge", [])
    assert chosen(1.11, 0.8, 2.0) == ("role_mean", ["validation_point_error"])
    assert chosen(1.0, 0.6, 3.1) == ("role_mean", ["validation_coverage", "validation_width"])


def test_group_detectability(spark):
    from turfline.operators import evaluation as E

    rng = np.random.default_rng(3)
    data = [(i, "r", i % 2 == 0, float(rng.normal(2.0 * (i % 2))), float(rng.normal())) for i in range(400)]
    rows = spark.createDataFrame(data, "id long, role string, side boolean, x double, y double")
    told = E.detectability(rows, "side", ["role"], "id", ["x", "y"], 50).first()
    blind = E.detectability(rows, "side", ["role"], "id", ["y"], 50).first()
    assert told.auc > 0.85 and told.balanced_accuracy > 0.75 and abs(blind.auc - 0.5) < 0.2
