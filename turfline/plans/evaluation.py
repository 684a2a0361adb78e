"""Evaluation queries: I1-I20."""

from __future__ import annotations

from pyspark.sql import functions as F

from turfline.operators import evaluation as E
from turfline.operators import profiles as P
from turfline.operators import similarity as S
from turfline.plans.profiles import RATES, rounded
from turfline.plans.registry import query
from turfline.plans.similarity import COS_SQL, FAM, GROUP, LONG
from turfline.plans.timesplit import HALVES_SQL, halves, window_pairs
from turfline.plans.views import PM_COUNTS
from turfline.session import settle

UNPIVOT = " UNION ALL ".join(
    f"SELECT player_id, win, role_first AS primary_role, '{c}' AS feature, {c} AS value FROM ok" for c in RATES
)
W = "0.125e0"
PAIR_SQL = f"""{HALVES_SQL},
ok AS (SELECT h.*, e.role_first FROM halves h JOIN excl e USING (player_id) WHERE exclusion IS NULL
  AND role_first IN (SELECT role_first FROM excl WHERE exclusion IS NULL GROUP BY role_first HAVING count(*) >= 3)),
hl AS ({UNPIVOT}),
hs AS (SELECT primary_role, feature, avg(value) AS m, stddev_pop(value) AS sd FROM hl WHERE win = 'first' GROUP BY ALL),
hz AS (SELECT player_id, win, primary_role, feature, (value - m) / sd AS z FROM hl JOIN hs USING (primary_role, feature)),
hd AS (SELECT a.primary_role, a.player_id, b.player_id AS other, sqrt(sum({W} * pow(a.z - b.z, 2))) AS d FROM hz a JOIN hz b
  ON a.win = 'first' AND b.win = 'second' AND a.primary_role = b.primary_role AND a.feature = b.feature GROUP BY ALL),
rk AS (SELECT x.primary_role, x.player_id, 1 + count(*) FILTER (WHERE y.d < x.d OR (y.d = x.d AND y.other < x.player_id)) AS rank,
  count(*) FILTER (WHERE y.d < x.d AND abs(y.d - x.d) > 1e-10) AS earlier, count(*) FILTER (WHERE abs(y.d - x.d) <= 1e-10) AS tied,
  count(*) AS candidates FROM hd x JOIN hd y ON x.player_id = x.other AND y.player_id = x.player_id GROUP BY ALL)"""


def paired_players(v, rows=None):
    """(player_id, primary_role) of usable pairs, under the common role."""
    pairs = window_pairs(v, rows).where(F.col("exclusion").isNull())
    if rows is None:
        pairs = settle(pairs, "pairs")
    sizes = pairs.groupBy("role_first").agg(F.count(F.lit(1)).alias("pairs"))
    return pairs.join(sizes.where(F.col("pairs") >= 3), "role_first").select(
        "player_id", F.col("role_first").alias("primary_role")
    )


def paired_halves(v):
    """(first, second) half profiles of usable pairs, under the common role."""
    rows = settle(halves(v), "halves")
    keep = paired_players(v, rows)
    used = settle(rows.drop("primary_role").join(keep, "player_id"), "pairs")
    side = lambda w: used.where(F.col("window") == w).drop("window")
    return side("first"), side("second")


def ranks(v):
    first, second = paired_halves(v)
    scaler = settle(S.fit_scaling(first, GROUP, FAM, "standard", balanced=False), "scaler")
    a = S.standardise(first, scaler, GROUP, RATES)
    b = S.standardise(second, scaler, GROUP, RATES)
    keep = lambda d, n: settle(d.select("primary_role", "player_id", "vec"), n)
    return settle(S.counterpart_ranks(keep(a, "first"), keep(b, "second"), GROUP, "player_id"), "ranks")


@query(
    "counterpart_ranks",
    "I1",
    f"WITH {PAIR_SQL} SELECT primary_role, player_id, rank, earlier, tied, candidates FROM rk",
    "pm",
)
def counterpart_ranks(v):
    return ranks(v)


METRIC_SQL = """count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1e0 ELSE 0 END), 6) AS recall1,
 round(avg(CASE WHEN rank <= 5 THEN 1e0 ELSE 0 END), 6) AS recall5, round(avg(CASE WHEN rank <= 10 THEN 1e0 ELSE 0 END), 6) AS recall10,
 round(avg(1e0 / rank), 6) AS mrr"""
RAND_SQL = """round(avg(least(1, candidates) / CAST(candidates AS DOUBLE)), 6) AS random_recall1,
 round(avg(least(5, candidates) / CAST(candidates AS DOUBLE)), 6) AS random_recall5,
 round(avg(least(10, candidates) / CAST(candidates AS DOUBLE)), 6) AS random_recall10,
 round(avg(list_sum(list_transform(range(1, candidates + 1), lambda i: 1e0 / i)) / candidates), 6) AS random_mrr"""


@query(
    "retrieval_metrics",
    "I1 I2 I3",
    f"WITH {PAIR_SQL} SELECT primary_role, {METRIC_SQL}, {RAND_SQL} FROM rk GROUP BY primary_role",
    "pm",
)
def retrieval_metrics(v):
    rows = ranks(v)
    out = E.retrieval_metrics(rows, GROUP).join(E.random_expectation(rows, GROUP), GROUP)
    return rounded(out, *[c for c in out.columns if c not in ("primary_role", "queries")])


@query(
    "retrieval_overall",
    "I2 I3",
    f"WITH {PAIR_SQL} SELECT {METRIC_SQL}, {RAND_SQL} FROM rk",
    "pm",
)
def retrieval_overall(v):
    rows = ranks(v).withColumn("g", F.lit(0))
    out = E.retrieval_metrics(rows, ["g"]).join(E.random_expectation(rows, ["g"]), "g").drop("g")
    return rounded(out, *[c for c in out.columns if c != "queries"])


@query(
    "tie_aware_retrieval",
    "I4",
    """WITH e AS (SELECT label, vec_id, round(CAST(embedding[1] AS DOUBLE) * 4) AS a, round(CAST(embedding[2] AS DOUBLE) * 4) AS b FROM embeddings),
x AS (SELECT p.label, p.vec_id, abs(p.a - q.b) AS d, abs(p.a - p.b) AS own, p.vec_id = q.vec_id AS me FROM e p JOIN e q USING (label)),
k AS (SELECT label, vec_id, count(*) FILTER (WHERE d < own AND abs(d - own) > 1e-10) AS earlier, count(*) FILTER (WHERE abs(d - own) <= 1e-10) AS tied FROM x GROUP BY ALL)
SELECT label, vec_id, earlier, tied, round(list_sum(list_transform(range(earlier + 1, earlier + tied + 1), lambda i: 1e0 / i)) / tied, 6) AS rr,
 round(least(greatest(5 - earlier, 0), tied) / CAST(tied AS DOUBLE), 6) AS tie_recall5 FROM k""",
)
def tie_aware_retrieval(v):
    step = lambda i: F.array(F.round(F.element_at("embedding", i).cast("double") * 4))
    rows = v.table("embeddings")
    first = rows.select("label", "vec_id", step(1).alias("vec"))
    second = rows.select("label", "vec_id", step(2).alias("vec"))
    out = E.tie_aware(S.counterpart_ranks(first, second, ["label"], "vec_id"))
    return rounded(
        out.select("label", "vec_id", "earlier", "tied", "rr", "tie_recall5"), "rr", "tie_recall5"
    )


DRAWS = 20
PICK = "CAST('0x' || substr(md5('{seed}:' || g.draw || ':' || CAST({key} AS VARCHAR) || ':' || CAST(r.place AS VARCHAR)), 1, 15) AS BIGINT) % r.size + 1"
BOOT_SQL = f"""nr AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY observed_on, match_id) AS place,
  count(*) OVER (PARTITION BY player_id) AS size FROM pm WHERE reliable AND player_id IN (SELECT player_id FROM co)),
pk AS (SELECT g.draw, r.player_id, {PICK.format(seed="boot", key="r.player_id")} AS place FROM nr r, range(1, {DRAWS + 1}) g(draw)),
bs AS (SELECT draw, pk.player_id, {", ".join(f"90 * sum({c}) / sum(minutes) AS {c}_per90" for c in PM_COUNTS)},
  100 * sum(pressures) / sum(opponent_possessions) AS pressures_per100 FROM pk JOIN nr ON nr.player_id = pk.player_id AND nr.place = pk.place GROUP BY ALL)"""


def observations(v):
    rows = P.usable(v.pm).withColumn("day", F.unix_date("observed_on"))
    return rows.join(v.co.select("player_id"), "player_id", "left_semi")


def boot(v, draws=DRAWS):
    return E.bootstrap_rates(
        observations(v), ["player_id"], "day", "match_id", PM_COUNTS, draws, "boot",
        {"pressures": "opponent_possessions"},
    )


@query(
    "bootstrap_rates",
    "I6 K10",
    f"WITH {BOOT_SQL} SELECT CAST(draw AS INT) AS draw, player_id, {', '.join(f'round({c}, 6) AS {c}' for c in [*RATES, 'pressures_per100'])} FROM bs",
    "co",
)
def bootstrap_rates(v):
    return rounded(boot(v), *RATES, "pressures_per100")


def drawn_neighbours(v, draws, k):
    """Baseline and per-draw neighbours, each draw refitted inside its role."""
    roles = v.co.select("player_id", "primary_role")
    drawn = settle(boot(v, draws).join(roles, "player_id"), "draws")
    group = ["draw", "primary_role"]
    scaler = settle(S.fit_scaling(drawn, group, FAM, "standard", balanced=False), "scaler")
    rows = S.standardise(drawn, scaler, group, RATES)
    base_scaler = settle(S.fit_scaling(v.co, GROUP, FAM, "standard", balanced=False), "scaler")
    base = S.nearest(S.standardise(v.co, base_scaler, GROUP, RATES), GROUP, "player_id", k)
    return settle(base, "base"), settle(S.nearest(rows, group, "player_id", k), "drawn")


STAB_SQL = f"""{LONG}, {BOOT_SQL.replace(f'range(1, {DRAWS + 1})', 'range(1, 6)')},
bl AS (SELECT 0 AS draw, player_id, primary_role, feature, value FROM l UNION ALL {
    " UNION ALL ".join(f"SELECT draw, bs.player_id, primary_role, '{c}', bs.{c} FROM bs JOIN co USING (player_id)" for c in RATES)}),
zs AS (SELECT draw, primary_role, feature, avg(value) AS m, stddev_pop(value) AS sd FROM bl GROUP BY ALL),
zz AS (SELECT draw, player_id, primary_role, feature, (value - m) / sd AS z FROM bl JOIN zs USING (draw, primary_role, feature)),
dd AS (SELECT a.draw, a.player_id, b.player_id AS other, sqrt(sum({W} * pow(a.z - b.z, 2))) AS d FROM zz a JOIN zz b
  ON a.draw = b.draw AND a.primary_role = b.primary_role AND a.feature = b.feature AND a.player_id <> b.player_id GROUP BY ALL),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY draw, player_id ORDER BY d, other) AS rank FROM dd) q WHERE rank <= 10),
iv AS (SELECT t.player_id, t.draw, count(*) FILTER (WHERE b.other IS NOT NULL) AS common FROM tk t LEFT JOIN tk b
  ON b.draw = 0 AND b.player_id = t.player_id AND b.other = t.other WHERE t.draw > 0 GROUP BY ALL)"""


@query(
    "bootstrap_stability",
    "I5 I7",
    f"WITH {STAB_SQL} SELECT player_id, round(avg(common / (20e0 - common)), 6) AS stability FROM iv GROUP BY player_id",
    "co",
)
def bootstrap_stability(v):
    base, drawn = drawn_neighbours(v, 5, 10)
    per_row, _ = E.bootstrap_stability(base, drawn, ["player_id"], 5)
    return rounded(per_row, "stability")


@query(
    "neighbour_inclusion",
    "I7 H12",
    f"""WITH {STAB_SQL} SELECT b.player_id, b.other AS neighbour, round(count(t.other) / 5e0, 6) AS inclusion FROM tk b
 LEFT JOIN tk t ON t.draw > 0 AND t.player_id = b.player_id AND t.other = b.other WHERE b.draw = 0 GROUP BY ALL""",
    "co",
)
def neighbour_inclusion(v):
    base, drawn = drawn_neighbours(v, 5, 10)
    return rounded(E.bootstrap_stability(base, drawn, ["player_id"], 5)[1], "inclusion")


# One row per way of measuring similarity: scaling, weighting and family left out.
METHODS = {
    "robust": ("robust", True, None),
    "standard": ("standard", True, None),
    "winsor": ("winsor", True, None),
    "unbalanced": ("robust", False, None),
    **{f"without_{f}": ("standard", True, f) for f in ("shooting", "creation", "passing", "carrying", "defending")},
}


# Scores of every scaling, with each feature's share of its family.
SCORES_SQL = f"""{COS_SQL},
cl AS (SELECT l.primary_role, l.player_id, l.feature, greatest(least(value, upper), lower) AS cut FROM l JOIN (SELECT primary_role, feature,
  quantile_cont(value, 0.01) AS lower, quantile_cont(value, 0.99) AS upper FROM l GROUP BY ALL) b USING (primary_role, feature)),
ws AS (SELECT primary_role, feature, quantile_cont(cut, 0.5) AS med, quantile_cont(cut, 0.75) - quantile_cont(cut, 0.25) AS s FROM cl GROUP BY ALL),
sg AS (SELECT sc.*, 1e0 / count(*) OVER (PARTITION BY primary_role, family) AS part FROM sc),
zs AS (SELECT l.primary_role, l.player_id, l.feature, l.family, part, (value - sg.med) / sg.s AS robust, (value - mean) / sd AS standard, (cut - ws.med) / ws.s AS winsor
  FROM l JOIN sg USING (primary_role, feature) JOIN cl USING (primary_role, player_id, feature) JOIN ws USING (primary_role, feature))"""
TOP_SQL = """ed AS (SELECT a.method, a.primary_role, a.player_id, b.player_id AS other, sqrt(sum(a.w * pow(a.z - b.z, 2))) AS d
  FROM me a JOIN me b ON a.method = b.method AND a.primary_role = b.primary_role AND a.feature = b.feature AND a.player_id <> b.player_id GROUP BY ALL),
et AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method, player_id ORDER BY d, other) AS place FROM ed) q WHERE place <= 10)"""
COMMON_SQL = """oc AS (SELECT a.method, a.primary_role, a.player_id, count(b.other) AS common, count(*) AS own,
  min((SELECT count(*) FROM et e WHERE e.method = 'standard' AND e.player_id = a.player_id)) AS base
  FROM every a LEFT JOIN et b ON b.method = 'standard' AND b.player_id = a.player_id AND b.other = a.other GROUP BY ALL)"""


@query(
    "method_sweep",
    "I18",
    f"""WITH {SCORES_SQL},
me AS (SELECT 'robust' AS method, primary_role, player_id, feature, robust AS z, part / 5 AS w FROM zs
  UNION ALL SELECT 'standard', primary_role, player_id, feature, standard, part / 5 FROM zs
  UNION ALL SELECT 'winsor', primary_role, player_id, feature, winsor, part / 5 FROM zs
  UNION ALL SELECT 'unbalanced', primary_role, player_id, feature, robust, 1e0 / 8 FROM zs
  UNION ALL SELECT 'without_' || f, primary_role, player_id, feature, standard, part / 4 FROM zs, (VALUES ('shooting'), ('creation'), ('passing'), ('carrying'), ('defending')) x(f) WHERE family <> f),
{TOP_SQL},
every AS (SELECT method, primary_role, player_id, other FROM et UNION ALL SELECT 'cosine', primary_role, player_id, neighbour FROM (
  SELECT *, row_number() OVER (PARTITION BY primary_role, player_id ORDER BY distance, neighbour) AS place FROM d) q WHERE place <= 10),
{COMMON_SQL}
SELECT method, primary_role, round(avg(CAST(common AS DOUBLE) / (own + base - common)), 6) AS overlap FROM oc GROUP BY ALL""",
    "co",
)
def method_sweep(v):
    """Overlap of every method's top ten with the default method's, per role.

    All methods are neighbours in one job: the method is part of the group key.
    """
    parts = []
    for name, (scaling, balanced, without) in METHODS.items():
        families = {f: g for f, g in FAM.items() if g != without}
        scaler = S.fit_scaling(v.co, GROUP, families, scaling, balanced)
        rows = S.standardise(v.co, scaler, GROUP, list(families))
        pad = [0.0] * (len(FAM) - len(families))
        vec = F.concat("vec", F.array(*[F.lit(x) for x in pad]).cast("array<double>")) if pad else F.col("vec")
        parts.append(rows.select(F.lit(name).alias("method"), "primary_role", "player_id", vec.alias("vec")))
    scaled = S.standardise(
        v.co, S.fit_scaling(v.co, GROUP, FAM, "standard", True), GROUP, RATES
    )
    cosine = S.cosine_vectors(scaled, FAM)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    euclid = settle(S.nearest(out, ["method", "primary_role"], "player_id", 10), "methods")
    angular = S.nearest(cosine, GROUP, "player_id", 10).withColumn("method", F.lit("cosine"))
    every = euclid.unionByName(angular.select(*euclid.columns))
    base = euclid.where(F.col("method") == "standard")
    compared = E.overlap(base, every, ["primary_role", "player_id"], ["method"])
    return rounded(
        compared.groupBy("method", "primary_role").agg(F.avg("jaccard").alias("overlap")), "overlap"
    )


@query(
    "family_perturbation",
    "I18",
    f"""WITH {SCORES_SQL},
me AS (SELECT 'standard' AS method, primary_role, player_id, feature, standard AS z, part / 5 AS w FROM zs
  UNION ALL SELECT f || ' ' || x, primary_role, player_id, feature, standard, CASE WHEN family = f THEN x ELSE 1 END * part / 5
  FROM zs, (VALUES ('shooting'), ('creation'), ('passing'), ('carrying'), ('defending')) g(f), (VALUES (0.5e0), (2e0)) h(x)),
{TOP_SQL},
every AS (SELECT method, primary_role, player_id, other FROM et WHERE method <> 'standard'),
{COMMON_SQL}
SELECT string_split(method, ' ')[1] AS family, CAST(string_split(method, ' ')[2] AS DOUBLE) AS factor, primary_role,
  round(avg(CAST(common AS DOUBLE) / base), 8) AS top10_overlap FROM oc GROUP BY ALL""",
    "co",
)
def family_perturbation(v):
    """Top-ten overlap when one family's weight is halved or doubled."""
    scaler = settle(S.fit_scaling(v.co, GROUP, FAM, "standard", True), "scaler")
    rows = settle(S.standardise(v.co, scaler, GROUP, RATES).select("primary_role", "player_id", "vec"), "scaled")
    grid = [(f, x) for f in dict.fromkeys(FAM.values()) for x in (0.5, 2.0)]
    weights = {"base": [1.0] * len(RATES)} | {f"{f} {x}": [x**0.5 if FAM[c] == f else 1.0 for c in RATES] for f, x in grid}
    found = S.nearest_weighted(rows, GROUP, "player_id", 10, weights)
    # The lists of a player lie in one row, so only sums leave a task.
    shared = lambda c: F.when(F.size(c) > 0, F.size(F.array_intersect("base", c)) / F.size("base"))
    means = found.groupBy(*GROUP).agg(*[F.avg(shared(F.col(f"`{f} {x}`"))).alias(f"{f} {x}") for f, x in grid])
    cells = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(x).alias("factor"), F.col(f"`{f} {x}`").alias("top10_overlap")) for f, x in grid])
    long = means.select("primary_role", F.explode(cells).alias("c")).select("c.family", "c.factor", "primary_role", "c.top10_overlap")
    return rounded(long.where(F.col("top10_overlap").isNotNull()), "top10_overlap", places=8)


SPEAR_SQL = f"""{PAIR_SQL},
ab AS (SELECT a.primary_role, a.feature, a.value AS x, b.value AS y FROM hl a JOIN hl b USING (player_id, primary_role, feature) WHERE a.win = 'first' AND b.win = 'second'),
rr2 AS (SELECT primary_role, feature, rank() OVER (PARTITION BY primary_role, feature ORDER BY x) + (count(*) OVER (PARTITION BY primary_role, feature, x) - 1) / 2e0 AS rx,
  rank() OVER (PARTITION BY primary_role, feature ORDER BY y) + (count(*) OVER (PARTITION BY primary_role, feature, y) - 1) / 2e0 AS ry FROM ab),
sp AS (SELECT primary_role, feature, corr(rx, ry) AS spearman FROM rr2 GROUP BY ALL)"""


@query(
    "spearman_stability",
    "I9",
    f"WITH {SPEAR_SQL} SELECT primary_role, feature, round(spearman, 6) AS spearman FROM sp",
    "pm",
)
def spearman_stability(v):
    first, second = paired_halves(v)
    return rounded(E.feature_stability(first, second, GROUP, "player_id", RATES), "spearman")


CI_SQL = """nr AS (SELECT c_mktsegment AS g, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS place,
  count(*) OVER (PARTITION BY c_mktsegment) AS size FROM customer),
pk AS (SELECT d.draw, r.g, CAST('0x' || substr(md5('ci:' || d.draw || ':' || r.g || ':' || CAST(r.place AS VARCHAR)), 1, 15) AS BIGINT) % r.size + 1 AS place FROM nr r, range(1, 51) d(draw)),
mm AS (SELECT pk.g, draw, avg(c_acctbal) AS m FROM pk JOIN nr ON nr.g = pk.g AND nr.place = pk.place GROUP BY ALL)"""


@query(
    "bootstrap_interval",
    "I10",
    f"WITH {CI_SQL} SELECT g, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM mm GROUP BY g",
)
def bootstrap_interval(v):
    rows = v.table("customer").select(F.col("c_mktsegment").alias("g"), "c_custkey", "c_acctbal")
    return rounded(E.bootstrap_mean(rows, ["g"], "c_acctbal", "c_custkey", 50, "ci"), "low", "high", places=4)


THRESHOLDS = (300, 450, 600)
CELL = ["threshold", "scope", "primary_role"]
CELL_UNPIVOT = " UNION ALL ".join(
    f"SELECT threshold, scope, provider, player_id, win, role_first AS primary_role, '{c}' AS feature, {c} AS value FROM tp" for c in RATES
)


@query(
    "scoped_retrieval",
    "I11 I12 H10 H11",
    f"""WITH {HALVES_SQL}, ok AS (SELECT h.*, e.role_first FROM halves h JOIN excl e USING (player_id) WHERE exclusion IS NULL),
lo AS (SELECT player_id, min(minutes) AS low, sum(minutes) AS whole FROM ok GROUP BY player_id),
tp AS (SELECT t.threshold, player_id % 3 AS scope, CASE WHEN player_id % 3 = 0 THEN 'p' ELSE 'q' END AS provider, ok.* FROM ok JOIN lo USING (player_id)
  JOIN (VALUES (300), (450), (600)) t(threshold) ON low >= t.threshold / 2e0 AND whole >= t.threshold),
hl AS ({CELL_UNPIVOT}),
hs AS (SELECT threshold, provider, primary_role, feature, avg(value) AS m, stddev_pop(value) AS sd FROM hl WHERE win = 'first' GROUP BY ALL),
hz AS (SELECT hl.*, (value - m) / sd AS z FROM hl JOIN hs USING (threshold, provider, primary_role, feature)),
hd AS (SELECT a.threshold, a.scope, a.provider, a.primary_role, a.player_id, b.player_id AS other, sqrt(sum({W} * pow(a.z - b.z, 2))) AS d FROM hz a JOIN hz b
  ON a.win = 'first' AND b.win = 'second' AND a.threshold = b.threshold AND a.scope = b.scope AND a.primary_role = b.primary_role AND a.feature = b.feature GROUP BY ALL),
rk AS (SELECT x.threshold, x.scope, x.provider, x.primary_role, x.player_id, 1 + count(*) FILTER (WHERE y.d < x.d OR (y.d = x.d AND y.other < x.player_id)) AS rank
  FROM hd x JOIN hd y ON x.player_id = x.other AND y.player_id = x.player_id AND y.threshold = x.threshold GROUP BY ALL),
m AS (SELECT threshold, scope, provider, primary_role, count(*) AS queries, avg(1e0 / rank) AS mrr FROM rk GROUP BY ALL HAVING count(*) >= 20),
s AS (SELECT threshold, provider, sum(mrr * queries) / sum(queries) AS score FROM m WHERE scope IN (0, 1) GROUP BY ALL),
a AS (SELECT threshold, avg(score) AS score FROM s GROUP BY threshold HAVING count(*) = 2)
SELECT min(threshold) AS threshold FROM a WHERE score + 1e-12 >= 0.9e0 * (SELECT max(score) FROM a)""",
    "pm",
)
def scoped_retrieval(v):
    """Cohorts rebuilt for every threshold; scalers per provider and role fitted on the first
    half; only counterparts of one scope and role compete; scopes 0 and 1 decide."""
    rows = settle(halves(v), "halves")
    pairs = window_pairs(v, rows).where(F.col("exclusion").isNull()).select("player_id", F.col("role_first").alias("primary_role"))
    used = rows.drop("primary_role").join(pairs, "player_id")
    low = used.groupBy("player_id").agg(F.min("minutes").alias("_low"), F.sum("minutes").alias("_whole"))
    cells = used.join(low, "player_id").withColumns(
        {
            "threshold": F.explode(F.array(*map(F.lit, THRESHOLDS))),
            "scope": F.col("player_id") % 3,
            "provider": F.when(F.col("player_id") % 3 == 0, "p").otherwise("q"),
        }
    )
    enough = (F.col("_low") >= F.col("threshold") / 2) & (F.col("_whole") >= F.col("threshold"))
    cells = settle(cells.where(enough), "cells")
    first, second = (cells.where(F.col("window") == w) for w in ("first", "second"))
    fitted = ["threshold", "provider", "primary_role"]
    scaler = settle(S.fit_scaling(first, fitted, FAM, "standard", balanced=False), "scaler")
    keep = lambda d, n: settle(S.standardise(d, scaler, fitted, RATES).select(*CELL, "player_id", "vec"), n)
    found = S.counterpart_ranks(keep(first, "first"), keep(second, "second"), CELL, "player_id")
    metrics = E.retrieval_metrics(found, CELL).where(F.col("queries") >= 20)
    sided = metrics.withColumn("provider", F.when(F.col("scope") == 0, "p").otherwise("q"))
    return E.select_threshold(sided, development=(0, 1))


@query("provider_classifier", "I13", None)
def provider_classifier(v):
    rows = v.co.withColumn("side", F.col("competition_id") == 0)
    return E.detectability(rows, "side", ["primary_role"], "player_id", RATES, 100)


DIST = """WITH v AS (SELECT c_mktsegment AS seg, c_acctbal AS x, c_nationkey % 2 = 0 AS a FROM customer),
t AS (SELECT seg, count(*) FILTER (WHERE a) AS na, count(*) FILTER (WHERE NOT a) AS nb FROM v GROUP BY seg),
d AS (SELECT seg, x, count(*) FILTER (WHERE a) AS ca, count(*) FILTER (WHERE NOT a) AS cb FROM v GROUP BY ALL),
e AS (SELECT seg, x, lead(x) OVER w AS nx, sum(ca) OVER w / na AS fa, sum(cb) OVER w / nb AS fb FROM d JOIN t USING (seg) WINDOW w AS (PARTITION BY seg ORDER BY x))
SELECT e.seg, round(max(abs(fa - fb)), 6) AS ks, round(sum(abs(fa - fb) * (nx - x)), 4) AS wasserstein,
 (SELECT count(*) FROM v WHERE v.seg = e.seg AND a) AS n_a, (SELECT count(*) FROM v WHERE v.seg = e.seg AND NOT a) AS n_b,
 (SELECT round(avg(x), 4) FROM v WHERE v.seg = e.seg AND a) AS mean_a, (SELECT round(avg(x), 4) FROM v WHERE v.seg = e.seg AND NOT a) AS mean_b,
 (SELECT round(quantile_cont(x, 0.5), 4) FROM v WHERE v.seg = e.seg AND a) AS median_a, (SELECT round(quantile_cont(x, 0.9), 4) FROM v WHERE v.seg = e.seg AND NOT a) AS q90_b
FROM e GROUP BY e.seg"""


@query("distribution_shift", "I14", DIST)
def distribution_shift(v):
    rows = v.table("customer").select(F.col("c_mktsegment").alias("seg"), "c_nationkey", "c_acctbal")
    out = E.two_group_distance(rows, ["seg"], F.col("c_nationkey") % 2 == 0, "c_acctbal")
    names = ["wasserstein", "mean_a", "mean_b", "median_a", "q90_b"]
    return rounded(rounded(out, "ks"), *names, places=4).select("seg", "ks", "n_a", "n_b", *names)


@query(
    "provider_balance",
    "I15",
    """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
d AS (SELECT a.label, a.vec_id, b.vec_id AS other, sum(pow(CAST(a.x AS DOUBLE) - CAST(b.x AS DOUBLE), 2)) AS d FROM e a JOIN e b ON a.label = b.label AND a.i = b.i AND a.vec_id <> b.vec_id GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS r FROM d) q WHERE r <= 5),
s AS (SELECT label, vec_id % 3 AS side, count(*) AS n FROM embeddings GROUP BY ALL)
SELECT label, round(avg(CASE WHEN vec_id % 3 = other % 3 THEN 1e0 ELSE 0 END), 6) AS neighbour_share,
 (SELECT round(sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)), 6) FROM s WHERE s.label = k.label) AS available_share FROM k GROUP BY label""",
)
def provider_balance(v):
    rows = v.table("embeddings").select(
        "label", "vec_id", F.col("embedding").cast("array<double>").alias("vec")
    )
    near = S.nearest(rows, ["label"], "vec_id", 5)
    sides = rows.select("label", "vec_id", (F.col("vec_id") % 3).alias("side"))
    out = E.group_balance(near, sides, "vec_id", ["label"], "side")
    return rounded(out, "neighbour_share", "available_share")


GATE_SQL = f"""{SPEAR_SQL},
md AS (SELECT primary_role, quantile_cont(spearman, 0.5) AS median_spearman FROM sp GROUP BY primary_role),
mt AS (SELECT primary_role, count(*) AS queries, avg(CASE WHEN rank <= 5 THEN 1e0 ELSE 0 END) AS recall5, avg(1e0 / rank) AS mrr,
  avg(least(5, candidates) / CAST(candidates AS DOUBLE)) AS rr5, avg(list_sum(list_transform(range(1, candidates + 1), lambda i: 1e0 / i)) / candidates) AS rmrr FROM rk GROUP BY primary_role),
gt AS (SELECT primary_role, queries, array_to_string(list_filter([CASE WHEN queries < 20 THEN 'fewer_than_registered_role_pairs' END,
  CASE WHEN median_spearman IS NULL OR median_spearman < 0.35 THEN 'profile_stability_below_registered_floor' END,
  CASE WHEN recall5 < 1.5 * rr5 THEN 'recall5_below_registered_random_multiple' END,
  CASE WHEN mrr < 1.5 * rmrr THEN 'mrr_below_registered_random_multiple' END], lambda z: z IS NOT NULL), ';') AS reasons FROM mt JOIN md USING (primary_role))"""


def gates(v):
    rows = ranks(v)
    first, second = paired_halves(v)
    stable = E.feature_stability(first, second, GROUP, "player_id", RATES)
    median = stable.groupBy("primary_role").agg(F.percentile("spearman", F.lit(0.5)).alias("median_spearman"))
    metrics = (
        E.retrieval_metrics(rows, GROUP)
        .join(E.random_expectation(rows, GROUP), GROUP)
        .join(median, GROUP, "left")
    )
    return E.role_gate(metrics, GROUP)


@query(
    "role_gate",
    "I17",
    f"WITH {GATE_SQL} SELECT primary_role, queries, reasons, reasons = '' AS passed FROM gt",
    "pm",
)
def role_gate(v):
    return gates(v).select(
        "primary_role", "queries", F.array_join("reasons", ";").alias("reasons"), "passed"
    )


@query(
    "threshold_grid",
    "",
    f"""WITH {GATE_SQL}, p AS (SELECT t.threshold, primary_role, reasons = '' AND queries >= t.threshold AS passed FROM gt, (VALUES (50), (100), (150)) t(threshold)),
c AS (SELECT min(threshold) AS threshold FROM (SELECT threshold FROM p GROUP BY threshold HAVING count(*) FILTER (WHERE passed) >= 2) q)
SELECT 'all' AS scope, c.threshold, coalesce((SELECT string_agg(primary_role, ',' ORDER BY primary_role) FROM p WHERE p.threshold = c.threshold AND passed), '') AS roles FROM c""",
    "pm",
)
def threshold_grid(v):
    grid = gates(v).withColumn("threshold", F.explode(F.array(*map(F.lit, (50, 100, 150))))).select(
        F.lit("all").alias("scope"),
        "threshold",
        "primary_role",
        (F.col("passed") & (F.col("queries") >= F.col("threshold"))).alias("passed"),
    )
    out = E.first_passing_threshold(grid, ["scope"])
    return out.withColumn("roles", F.array_join("roles", ","))
