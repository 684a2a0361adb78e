import hashlib
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from turfline.functions import measures as M
from turfline.functions import pitch as P
from turfline.functions import text as X


def lit(*values):
    return [F.lit(v) for v in values]


def test_rate_per_90(one):
    null = F.lit(None).cast("double")
    rows = one(
        M.per90(F.lit(2.0), F.lit(60.0)), M.per90(F.lit(0.0), F.lit(90.0)), M.per90(null, F.lit(90.0)),
        M.per90(F.lit(1.0), null), M.per90(F.lit(1.0), F.lit(0.0)),
    )
    assert rows == (3.0, 0.0, None, None, None)


def test_progressive_rules(one):
    assert one(
        P.progressive_relative(*lit(20.0, 34.0, 50.0, 34.0)),
        P.progressive_relative(*lit(50.0, 34.0, 55.0, 34.0)),
        P.progressive_relative(*lit(60.0, 34.0, 20.0, 34.0)),
        P.progressive_relative(*lit(85.0, 34.0, 55.0, 34.0), attack_left=F.lit(True)),
    ) == (True, False, False, True)
    assert one(
        P.progressive_zone(*lit(10.0, 34.0, 45.0, 34.0)),
        P.progressive_zone(*lit(10.0, 34.0, 35.0, 34.0)),
        P.progressive_zone(*lit(45.0, 34.0, 61.0, 34.0)),
        P.progressive_zone(*lit(60.0, 34.0, 70.5, 34.0)),
        P.progressive_zone(*lit(60.0, 34.0, 40.0, 34.0)),
    ) == (True, False, True, True, False)


@pytest.mark.parametrize("system", [dict(length=120, width=80, y_down=True), dict(length=105, width=68, centered=True)])
@pytest.mark.parametrize("left", [False, True])
def test_coordinates_round_trip(spark, system, left):
    rows = spark.createDataFrame([(0.0, 0.0), (105.0, 68.0), (33.3, 12.1)], "x double, y double")
    px, py = P.from_reference_pitch("x", "y", attack_left=left, **system)
    back = rows.select("x", "y", px.alias("px"), py.alias("py"))
    bx, by = P.to_reference_pitch("px", "py", attack_left=left, **system)
    for r in back.select("x", "y", bx.alias("bx"), by.alias("by")).collect():
        assert abs(r.x - r.bx) < 1e-9 and abs(r.y - r.by) < 1e-9


def test_outside_is_null_pair(one):
    x, y = P.to_reference_pitch(F.lit(130.0), F.lit(10.0), 120, 80)
    a, b = P.parse_pair(F.lit(10.0), F.lit(101.0), 100.0, 100.0)
    assert one(x, y, a, b) == (None, None, None, None)


def test_entity_key_is_uuid5(spark):
    rows = spark.range(50).select("id", X.entity_key("p", "players", "id").alias("k")).collect()
    for r in rows:
        assert r.k == str(uuid.uuid5(uuid.NAMESPACE_URL, f"fri:p:players:{r.id}"))


def test_digest_fold_matches_big_integer(spark):
    rows = spark.range(60).select("id", M.digest_fold(F.col("id"), 5, "a:").alias("f"), M.digest_fold(F.col("id"), 7).alias("g")).collect()
    for r in rows:
        assert r.f == int(hashlib.sha256(f"a:{r.id}".encode()).hexdigest(), 16) % 5
        assert r.g == int(hashlib.sha256(str(r.id).encode()).hexdigest(), 16) % 7


def test_names(spark):
    names = [
        "José  Ángel", "Ødegaard", "Łukasz-Fabiański", "STRASSE straße", "İlkay", "O'Neil", "ﬁne ½ ㎏", "Андрей Йорданов", "Άρης Θεσσαλονίκης",
        "ΑΣ ΟΔΟΣ", "한국 이름", "हिन्दी नाम", "ＦＣ Ｔokyo", "e\u0301a", "\u00a0x\u2003y ", "", None,
    ]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", X.normalise_name("n").alias("a")).collect()
    for r in rows:
        want = None if r.n is None else " ".join(re.sub(r"[^\w\s]", " ", X._fold_exact(r.n)).split())
        assert r.a == want, r.n
    assert rows[0].a == "jose angel" and rows[3].a == "strasse strasse" and rows[8].a == "αρησ θεσσαλονικησ"


def test_positions_and_families(one):
    assert one(
        X.position_group(F.lit("Right Centre Back")), X.position_group(F.lit("Left Wing Back")),
        X.position_group(F.lit("Left Midfield")), X.position_group(F.lit("Center Forward")),
        X.role_family(F.lit("AM")), X.role_family(F.lit("??")),
    ) == ("CB", "FB/WB", "W", "ST", "MID", None)
    assert one(X.clock_seconds(F.lit("00:01:02.500")), X.decode_escapes(F.lit("\\u00e9a"))) == (62.5, "éa")


def test_mismatch(one):
    def losses(preference, values):
        return one(*[M.mismatch(F.lit(float(v)), F.lit(75.0), F.lit(preference)) for v in values])

    assert losses("exact", [75, 65, 40]) == (0, 10, 35)
    assert losses("minimum", [90, 75, 60]) == (0, 0, 15)
    assert losses("maximum", [60, 75, 90]) == (0, 0, 15)
    assert losses("neutral", [0, 100]) == (0, 0)


def test_null_poisoning(spark):
    rows = spark.createDataFrame([(1, True, 2.0), (1, True, None), (2, True, 3.0), (2, False, None), (3, False, None)], "k int, r boolean, v double")
    got = rows.groupBy("k").agg(M.poisoned_sum("v", F.col("r"), F.col("v").isNull()).alias("s")).collect()
    assert {r.k: r.s for r in got} == {1: None, 2: 3.0, 3: 0.0}


def test_uniform_draws_cover_range(spark):
    values = [r.u for r in spark.range(500).select(M.uniform_draw(0.8, 1.2, F.lit("s"), "id").alias("u")).collect()]
    assert min(values) >= 0.8 and max(values) < 1.2 and abs(np.mean(values) - 1) < 0.02
