"""Similarity queries: H1-H16."""

from __future__ import annotations

from pyspark.sql import functions as F

from turfline.operators import similarity as S
from turfline.plans.linear_sql import eigen_sql
from turfline.plans.profiles import LONG_CO, RATES, rounded
from turfline.plans.registry import query
from turfline.plans.views import PM_FAMILIES
from turfline.session import settle

FAM = {f"{c}_per90": f for c, f in PM_FAMILIES.items()}
FAMILY_CASE = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{g}'" for f, g in FAM.items()) + " END"
GROUP = ["primary_role"]

LONG = f"l AS (SELECT *, {FAMILY_CASE} AS family FROM ({LONG_CO}) q)"
SCALER_SQL = f"""{LONG},
st AS (SELECT primary_role, feature, family, avg(value) AS mean, stddev_pop(value) AS sd, quantile_cont(value, 0.5) AS med,
  quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM l GROUP BY ALL),
sc AS (SELECT *, CASE WHEN iqr < 1e-10 THEN sd ELSE iqr END AS s FROM st),
ac AS (SELECT *, s >= 1e-10 AS active, sd >= 1e-10 AS sactive FROM sc),
wt AS (SELECT *, CASE WHEN active THEN 1e0 / ((SELECT count(DISTINCT family) FROM ac b WHERE b.primary_role = ac.primary_role AND b.active)
   * (SELECT count(*) FROM ac b WHERE b.primary_role = ac.primary_role AND b.family = ac.family AND b.active)) ELSE 0 END AS weight FROM ac)"""
Z_SQL = f"""{SCALER_SQL},
z AS (SELECT l.player_id, l.primary_role, l.feature, l.family, weight, active,
  CASE WHEN active THEN (value - med) / s ELSE 0 END AS z FROM l JOIN wt USING (primary_role, feature)),
d AS (SELECT a.primary_role, a.player_id, b.player_id AS neighbour, sqrt(sum(a.weight * pow(a.z - b.z, 2))) AS distance
  FROM z a JOIN z b ON a.primary_role = b.primary_role AND a.feature = b.feature AND a.player_id <> b.player_id GROUP BY ALL),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY primary_role, player_id ORDER BY distance, neighbour) AS rank FROM d) r WHERE rank <= 10)"""


def scaled(v, scaling="robust", balanced=True):
    scaler = settle(S.fit_scaling(v.co, GROUP, FAM, scaling, balanced), "scaler")
    return S.standardise(v.co, scaler, GROUP, RATES), scaler


@query(
    "scaler_robust",
    "H1 H2 H16",
    f"""WITH {SCALER_SQL} SELECT primary_role, feature, family, round(med, 6) AS centre, round(CASE WHEN active THEN s ELSE 1 END, 6) AS scale,
 active, iqr < 1e-10 AS std_fallback, round(weight, 6) AS weight FROM wt""",
    "co",
)
def scaler_robust(v):
    out = S.fit_scaling(v.co, GROUP, FAM, "robust").drop("lower", "upper")
    return rounded(out, "centre", "scale", "weight")


@query(
    "scaler_standard",
    "H1 H2",
    f"""WITH {SCALER_SQL} SELECT primary_role, feature, family, round(mean, 6) AS centre, round(sd, 6) AS scale, sactive AS active,
 sd < 1e-10 AS std_fallback, round(1e0 / 8, 6) AS weight FROM wt""",
    "co",
)
def scaler_standard(v):
    out = S.fit_scaling(v.co, GROUP, FAM, "standard", balanced=False).drop("lower", "upper")
    return rounded(out, "centre", "scale", "weight")


WINSOR_SQL = f"""{LONG},
b AS (SELECT primary_role, feature, quantile_cont(value, 0.01) AS lower, quantile_cont(value, 0.99) AS upper FROM l GROUP BY ALL)"""


@query(
    "scaler_winsor",
    "H1",
    f"""WITH {WINSOR_SQL}, c AS (SELECT primary_role, feature, lower, upper, greatest(least(value, upper), lower) AS value FROM l JOIN b USING (primary_role, feature))
SELECT primary_role, feature, round(min(lower), 6) AS lower, round(max(upper), 6) AS upper, round(quantile_cont(value, 0.5), 6) AS centre,
 round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS scale FROM c GROUP BY ALL""",
    "co",
)
def scaler_winsor(v):
    out = S.fit_scaling(v.co, GROUP, FAM, "winsor")
    return rounded(
        out.select("primary_role", "feature", "lower", "upper", "centre", "scale"),
        "lower", "upper", "centre", "scale",
    )


@query(
    "outlier_audit",
    "H14",
    f"""WITH {WINSOR_SQL} SELECT primary_role, feature, player_id, round(value, 6) AS value, round(lower, 6) AS lower, round(upper, 6) AS upper
FROM l JOIN b USING (primary_role, feature) WHERE value < lower - 1e-9 OR value > upper + 1e-9""",
    "co",
)
def outlier_audit(v):
    out = S.outlier_audit(v.co, GROUP, "player_id", FAM)
    return rounded(
        out.select("primary_role", "feature", "player_id", "value", "lower", "upper"),
        "value", "lower", "upper",
    )


@query(
    "knn_topk",
    "H3 H7 H11",
    f"WITH {Z_SQL} SELECT primary_role, player_id, neighbour, round(distance, 6) AS distance, rank FROM nn",
    "co",
)
def knn_topk(v):
    rows, _ = scaled(v)
    out = S.nearest(rows, GROUP, "player_id", 10)
    return rounded(out, "distance").withColumn("rank", F.col("rank").cast("bigint"))


EXPLAIN_SQL = f"""{Z_SQL},
ex AS (SELECT n.player_id, n.neighbour, a.feature, a.family, a.active, b.z - a.z AS diff, a.weight * pow(b.z - a.z, 2) AS sq, n.distance
  FROM nn n JOIN z a ON a.player_id = n.player_id JOIN z b ON b.player_id = n.neighbour AND b.feature = a.feature WHERE n.rank <= 3)"""


def explained(v, k=3):
    rows, scaler = scaled(v)
    rows = settle(rows.select("primary_role", "player_id", "z", "vec"), "scaled")
    pairs = S.nearest(rows, GROUP, "player_id", k)
    return pairs, S.explain_pairs(pairs, rows, GROUP, "player_id", FAM, scaler)


@query(
    "knn_explain",
    "H6",
    f"""WITH {EXPLAIN_SQL} SELECT player_id, neighbour, feature, family, round(diff, 6) AS standardised_difference,
 round(sq, 6) AS squared_contribution, round(CASE WHEN distance > 0 THEN sq / pow(distance, 2) ELSE 0 END, 6) AS share FROM ex""",
    "co",
)
def knn_explain(v):
    _, long = explained(v)
    names = ["standardised_difference", "squared_contribution", "share"]
    return rounded(long.select("player_id", "neighbour", "feature", "family", *names), *names)


@query(
    "knn_explain_summary",
    "H6 H12",
    f"""WITH {EXPLAIN_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY player_id, neighbour ORDER BY abs(diff), feature) AS lo,
  row_number() OVER (PARTITION BY player_id, neighbour ORDER BY -abs(diff), feature) AS hi FROM ex WHERE active)
SELECT player_id, neighbour, string_agg(CASE WHEN lo <= 3 THEN feature END, ',' ORDER BY lo) AS similar,
 string_agg(CASE WHEN hi <= 3 THEN feature END, ',' ORDER BY hi) AS different,
 round(sum(CASE WHEN family = 'passing' THEN sq END) / pow(min(distance), 2), 6) AS passing_share FROM r GROUP BY player_id, neighbour""",
    "co",
)
def knn_explain_summary(v):
    pairs, long = explained(v)
    summary = S.explanation_summary(long, ["player_id", "neighbour"])
    nested = S.publish_neighbours(
        pairs,
        summary.withColumn("similar", F.struct("similar", F.col("families.passing").alias("p"))),
        None,
        "player_id",
    )
    rows = nested.select("player_id", F.explode("neighbours").alias("n"))
    return rows.select(
        "player_id",
        "n.neighbour",
        F.array_join("n.similar.similar", ",").alias("similar"),
        F.array_join("n.different", ",").alias("different"),
        F.round("n.similar.p", 6).alias("passing_share"),
    )


COS_SQL = f"""{SCALER_SQL},
z AS (SELECT l.player_id, l.primary_role, l.feature, l.family, (value - mean) / sd AS z FROM l JOIN wt USING (primary_role, feature)),
nf AS (SELECT player_id, family, sqrt(sum(z * z)) AS n FROM z GROUP BY ALL),
cf AS (SELECT a.primary_role, a.player_id, b.player_id AS neighbour, a.family, sum(a.z * b.z) AS dot FROM z a JOIN z b
  ON a.primary_role = b.primary_role AND a.feature = b.feature AND a.player_id <> b.player_id GROUP BY ALL),
d AS (SELECT primary_role, cf.player_id, neighbour, avg(1 - dot / (x.n * y.n)) AS distance FROM cf JOIN nf x ON x.player_id = cf.player_id AND x.family = cf.family
  JOIN nf y ON y.player_id = neighbour AND y.family = cf.family GROUP BY ALL)"""


@query(
    "knn_cosine_family",
    "H4",
    f"""WITH {COS_SQL} SELECT primary_role, player_id, neighbour, round(distance, 5) AS distance, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY primary_role, player_id ORDER BY distance, neighbour) AS rank FROM d) r WHERE rank <= 5""",
    "co",
)
def knn_cosine_family(v):
    rows, _ = scaled(v, "standard")
    out = S.nearest(S.cosine_vectors(rows, FAM), GROUP, "player_id", 5)
    return out.select(
        "primary_role", "player_id", "neighbour",
        F.round(F.col("distance") * F.col("distance"), 5).alias("distance"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@query(
    "knn_embeddings",
    "H3 H7",
    """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
d AS (SELECT a.label, a.vec_id, b.vec_id AS neighbour, sqrt(sum(pow(CAST(a.x AS DOUBLE) - CAST(b.x AS DOUBLE), 2))) AS distance
  FROM e a JOIN e b ON a.label = b.label AND a.i = b.i AND a.vec_id <> b.vec_id GROUP BY ALL)
SELECT label, vec_id, neighbour, round(distance, 5) AS distance, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY label, vec_id ORDER BY distance, neighbour) AS rank FROM d) r WHERE rank <= 5""",
)
def knn_embeddings(v):
    rows = v.table("embeddings").select(
        "label", "vec_id", F.col("embedding").cast("array<double>").alias("vec")
    )
    out = S.nearest(rows, ["label"], "vec_id", 5)
    return rounded(out, "distance", places=5).withColumn("rank", F.col("rank").cast("bigint"))


def components_sql(group: str, count: int) -> str:
    """Standardised weighted values ``c_z`` of the groups and their leading components ``pc``."""
    active = "(SELECT * FROM c_s WHERE sd >= 1e-10)"
    return f"""{LONG}, c_s AS (SELECT {group} AS g, feature, family, avg(value) AS m, stddev_pop(value) AS sd FROM l GROUP BY ALL),
c_w AS (SELECT c_s.*, CASE WHEN sd >= 1e-10 THEN 1e0 / ((SELECT count(DISTINCT family) FROM {active} b WHERE b.g = c_s.g)
  * (SELECT count(*) FROM {active} b WHERE b.g = c_s.g AND b.family = c_s.family)) ELSE 0 END AS w FROM c_s),
c_z AS (SELECT l.player_id, l.primary_role, c_w.g, l.feature, CASE WHEN sd >= 1e-10 THEN (value - m) / sd * sqrt(w) ELSE 0 END AS z
  FROM l JOIN c_w ON c_w.feature = l.feature AND c_w.g = {group}),
c_v AS (SELECT a.g, a.feature AS fa, b.feature AS fb, avg(a.z * b.z) AS c FROM c_z a JOIN c_z b USING (player_id, g) GROUP BY ALL),
c_f AS (SELECT feature, row_number() OVER (ORDER BY feature) AS place FROM (SELECT DISTINCT feature FROM c_z) q),
{eigen_sql("c_v", count, "c_c")}"""


@query(
    "knn_pca",
    "H5",
    f"""WITH RECURSIVE {components_sql("primary_role", len(RATES))},
c_k AS (SELECT g, comps, list_filter(range(1, {len(RATES) + 1}), lambda i: i = 1 OR list_sum(lams[1:i - 1]) / total <= 0.90) AS kept FROM c_c),
c_x AS (SELECT player_id, primary_role, k, sum(z * comps[k][place]) AS score FROM (SELECT g, comps, unnest(kept) AS k FROM c_k) q JOIN c_z USING (g) JOIN c_f USING (feature) GROUP BY ALL),
c_d AS (SELECT a.primary_role, a.player_id, b.player_id AS neighbour, sqrt(sum(pow(a.score - b.score, 2))) AS distance
  FROM c_x a JOIN c_x b ON a.primary_role = b.primary_role AND a.k = b.k AND a.player_id <> b.player_id GROUP BY ALL)
SELECT primary_role, player_id, neighbour, rank, round(distance, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY primary_role, player_id ORDER BY distance, neighbour) AS rank FROM c_d) q WHERE rank <= 5""",
    "co",
)
def knn_pca(v):
    rows, _ = scaled(v, "standard")
    rows = settle(rows.select("primary_role", "player_id", "vec"), "scaled")
    fitted = S.fit_components(rows, GROUP)
    scores = S.project(rows, fitted, GROUP, S.kept_components(), "score")
    return rounded(
        S.nearest(scores.select("primary_role", "player_id", F.col("score").alias("vec")), GROUP, "player_id", 5),
        "distance",
    )


@query(
    "pca_map",
    "H13",
    f"""WITH RECURSIVE {components_sql("0", 2)}
SELECT player_id, primary_role, round(sum(z * comps[1][place]), 6) AS pc1, round(sum(z * comps[2][place]), 6) AS pc2
FROM c_z JOIN c_c USING (g) JOIN c_f USING (feature) GROUP BY player_id, primary_role""",
    "co",
)
def pca_map(v):
    scaler = settle(S.fit_scaling(v.co, [], FAM, "standard"), "scaler")
    rows = settle(S.standardise(v.co, scaler, [], RATES).select("player_id", "primary_role", "vec"), "scaled")
    fitted = S.fit_components(rows, [])
    out = S.project(rows, fitted, [], F.lit(2), "score")
    return out.select(
        "player_id",
        "primary_role",
        F.round(F.element_at("score", 1), 6).alias("pc1"),
        F.round(F.element_at("score", 2), 6).alias("pc2"),
    )


@query(
    "pca_loadings",
    "H15",
    f"""WITH RECURSIVE {components_sql("primary_role", 1)}
SELECT primary_role, rank, feature, round(loading, 6) AS loading FROM (SELECT *, row_number() OVER (PARTITION BY primary_role ORDER BY abs(loading) DESC, feature) AS rank
 FROM (SELECT g AS primary_role, feature, comps[1][place] AS loading FROM c_c, c_f) q) r WHERE rank <= 4""",
    "co",
)
def pca_loadings(v):
    rows, _ = scaled(v, "standard")
    return rounded(S.top_loadings(S.fit_components(rows, GROUP), GROUP, RATES), "loading")


@query(
    "scaler_variants",
    "H10",
    f"""WITH {LONG} SELECT 'raw' AS variant, '' AS boundary, feature, 0e0 AS centre, 1e0 AS scale FROM l GROUP BY feature
UNION ALL SELECT 'shared', '', feature, round(avg(value), 6), round(stddev_pop(value), 6) FROM l GROUP BY feature
UNION ALL SELECT 'role', primary_role, feature, round(avg(value), 6), round(stddev_pop(value), 6) FROM l GROUP BY primary_role, feature""",
    "co",
)
def scaler_variants(v):
    out = S.fit_variants(v.co, {"raw": [], "shared": [], "role": ["primary_role"]}, RATES)
    return rounded(out, "centre", "scale")
