"""Season profiles from one pass over the rows: sums per role carry the totals and the primary role."""

from pyspark.sql import functions as F

from turfline.operators import profiles as P

ROWS = [
    ("a", "CB", 60.0, True, 1.0, 2.0, 5), ("a", "CM", 60.0, True, 1.0, None, 3), ("a", "unknown", 30.0, True, 4.0, 1.0, 4),
    ("b", "unknown", 90.0, True, 0.0, 0.0, 1),
    ("c", "ST", 40.0, True, 2.0, 2.0, 2), ("c", "W", 25.0, True, None, 2.0, 2), ("c", "CM", 35.0, True, 1.0, 1.0, 9),
    ("d", "W", 59.0, True, 1.0, 1.0, 1), ("d", None, 41.0, True, 1.0, 1.0, 1),
    ("e", "GK", 90.0, False, 1.0, 1.0, 1), ("e", "CB", 0.0, True, 1.0, 1.0, 1),
    ("f", "CB", 10.0, True, 3.0, 1.0, 7), ("f", "CB", 20.0, True, 3.0, 1.0, 6), ("f", "CB", 5.0, False, 3.0, None, 0),
    (None, "CB", 90.0, True, 1.0, 1.0, 1),
]


def test_profiles_read_their_rows_once(spark):
    rows = spark.createDataFrame(ROWS, "player_id string, role string, minutes double, reliable boolean, shots double, passes double, club int")
    got = P.season_profiles(rows, ["player_id"], ["shots", "passes"], ["club"])
    # Three reads of the rows before: totals, minutes per role and minutes of all roles.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    totals = P.season_totals(rows, ["player_id"], ["shots", "passes"], ["club"])
    roles = P.role_summary(P.observation_roles(P.usable(rows), ["player_id"]), ["player_id"]).select("player_id", "primary_role")
    rates = [(F.col(c) * 90 / F.col("minutes")).alias(f"{c}_per90") for c in ("shots", "passes")]
    want = totals.join(roles, ["player_id"], "left").select("player_id", "minutes", "club", "appearances", "primary_role", *rates)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    order = lambda frame: sorted(map(tuple, frame.collect()), key=repr)
    assert order(got) == order(want)
    assert {r.player_id: r.primary_role for r in got.collect()} == {"a": "CB", "b": None, "c": "ST", "d": None, "f": "CB", None: None}
