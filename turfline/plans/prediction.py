"""Prediction queries: K1-K16."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from turfline.operators import evaluation as E
from turfline.operators import prediction as K
from turfline.operators.ordering import group_quantiles
from turfline.plans.linear_sql import solve_sql
from turfline.plans.profiles import rounded
from turfline.plans.registry import query
from turfline.plans.timesplit import ENV_SQL, FOLD, TRANS_SQL, env, episodes, numbered
from turfline.session import settle

ROLES = ["CB", "CM", "FB/WB", "GK", "ST", "W", "unknown"]

EP_SQL = f"""{TRANS_SQL},
ep AS (SELECT *, source_passes * 90e0 / source_minutes AS source_rate, destination_passes * 90e0 / destination_minutes AS actual,
  CASE WHEN destination_season < 2000 THEN 'train' ELSE 'test' END AS part FROM tr
  WHERE len(reasons) = 0 AND source_minutes > 0 AND destination_minutes > 0),
rm AS (SELECT destination_role, sum(destination_passes) / sum(destination_minutes / 90) AS role_mean FROM ep WHERE part = 'train' GROUP BY 1),
om AS (SELECT sum(destination_passes) / sum(destination_minutes / 90) AS mean FROM ep WHERE part = 'train'),
pr AS (SELECT ep.*, coalesce(role_mean, mean) AS point FROM ep LEFT JOIN rm USING (destination_role), om WHERE part = 'test'),
fd AS (SELECT *, {FOLD.format(k="CAST(player_id AS VARCHAR)")} AS fold FROM ep WHERE part = 'train'),
rs AS (SELECT actual - coalesce((SELECT sum(b.destination_passes) / sum(b.destination_minutes / 90) FROM fd b WHERE b.destination_role = a.role AND b.fold <> a.fold),
   (SELECT sum(b.destination_passes) / sum(b.destination_minutes / 90) FROM fd b WHERE b.fold <> a.fold)) AS r
  FROM (SELECT actual, destination_role AS role, fold FROM fd) a),
ct AS (SELECT r - (SELECT avg(r) FROM rs) AS residual FROM rs),
dw AS (SELECT pr.source_environment_id AS sid, actual, point, {", ".join(f"quantile_cont(greatest(0, point + residual), {q}) AS {n}" for n, q in K.interval_probs().items())}
  FROM pr, ct GROUP BY ALL)"""


def parts(v):
    """(train, test) episodes with pass rates."""
    rows = episodes(v).where(
        F.col("structurally_eligible") & (F.col("source_minutes") > 0) & (F.col("destination_minutes") > 0)
    )
    rows = settle(K.with_rates(rows, "passes"), "episodes")
    early = F.col("destination_season") < 2000
    return rows.where(early), rows.where(~early)


@query(
    "baseline_role_mean",
    "K4",
    f"WITH {EP_SQL} SELECT source_environment_id, round(actual, 6) AS actual, round(point, 6) AS point FROM pr",
    "pm",
)
def baseline_role_mean(v):
    train, test = parts(v)
    out = K.predict_role_mean(test, train)
    return rounded(out.select("source_environment_id", "actual", "point"), "actual", "point")


@query(
    "residuals",
    "K6 G4",
    f"WITH {EP_SQL} SELECT count(*) AS n, round(min(residual), 6) AS low, round(max(residual), 6) AS high, round(sum(residual * residual), 4) AS squares FROM ct",
    "pm",
)
def residuals(v):
    train, _ = parts(v)
    out = K.role_mean_residuals(train).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.min("residual"), 6).alias("low"),
        F.round(F.max("residual"), 6).alias("high"),
        F.round(F.sum(F.col("residual") * F.col("residual")), 4).alias("squares"),
    )
    return out


def predicted(v):
    train, test = parts(v)
    res = settle(K.role_mean_residuals(train), "residuals")
    return train, K.with_quantiles(K.predict_role_mean(test, train), res, K.interval_probs())


METRICS = "count(*) AS n, round(avg(abs(actual - point)), 6) AS mae, round(sqrt(avg(pow(actual - point, 2))), 6) AS rmse, " + ", ".join(
    f"round(avg(CASE WHEN actual BETWEEN lo{c} AND hi{c} THEN 1e0 ELSE 0 END), 6) AS coverage{c}, round(avg(hi{c} - lo{c}), 6) AS width{c}, "
    f"round(avg(hi{c} - lo{c} + 2 / (1 - {c / 100}) * (greatest(lo{c} - actual, 0) + greatest(actual - hi{c}, 0))), 6) AS score{c}"
    for c in K.COVERAGES
)
NAMES = ["mae", "rmse", *[f"{m}{c}" for c in K.COVERAGES for m in ("coverage", "width", "score")]]


@query(
    "interval_metrics",
    "K6 K7",
    f"WITH {EP_SQL} SELECT {METRICS} FROM dw",
    "pm",
)
def interval_metrics(v):
    _, rows = predicted(v)
    return rounded(K.interval_metrics(rows), *NAMES)


@query(
    "subgroup_metrics",
    "K9",
    f"""WITH {EP_SQL}, b AS (SELECT quantile_cont(actual, 0.1) AS d10, quantile_cont(actual, 0.9) AS d90 FROM pr),
t AS (SELECT dw.*, player_id, environments.a AS s_team, environments.b AS d_team FROM dw JOIN pr ON pr.source_environment_id = sid
  JOIN (SELECT x.environment_id AS sid2, x.team_id AS a, y.team_id AS b, y.environment_id AS did FROM env x, env y WHERE x.player_id = y.player_id) environments
  ON environments.sid2 = sid AND environments.did = pr.destination_environment_id),
g AS (SELECT t.*, unnest(list_filter(['all', CASE WHEN s_team = d_team THEN 'same_team' ELSE 'changed_team' END,
  CASE WHEN player_id NOT IN (SELECT player_id FROM ep WHERE part = 'train') THEN 'unseen_player' END,
  CASE WHEN actual <= d10 THEN 'bottom_decile' END, CASE WHEN actual >= d90 THEN 'top_decile' END], lambda z: z IS NOT NULL)) AS subgroup FROM t, b)
SELECT subgroup, count(*) AS n, round(avg(abs(actual - point)), 6) AS mae FROM g GROUP BY subgroup""",
    "pm",
)
def subgroup_metrics(v):
    train, rows = predicted(v)
    bounds = group_quantiles(rows.withColumn("g", F.lit(0)), ["g"], "actual", {"d10": 0.1, "d90": 0.9})
    tagged = K.subgroups(rows, train, bounds.drop("g"))
    return rounded(K.interval_metrics(tagged, ["subgroup"]).select("subgroup", "n", "mae"), "mae")


RIDGE_COLUMNS = [
    "source_rate",
    "ln(source_minutes / 900)",
    "ln((d_team + 10e0) / (s_team + 10e0))",
    "CASE WHEN role_change <> 'same' THEN 1e0 ELSE 0 END",
    *[f"CASE WHEN {side}_role = '{r}' THEN 1e0 ELSE 0 END" for side in ("source", "destination") for r in ROLES],
]
# Fit -1 takes all training rows, fit f those of the other folds.
RIDGE_SQL = f"""{EP_SQL},
rx AS (SELECT ep.*, x.team_id AS s_team, y.team_id AS d_team, {FOLD.format(k="CAST(ep.player_id AS VARCHAR)")} AS fold
  FROM ep JOIN env x ON x.environment_id = source_environment_id JOIN env y ON y.environment_id = destination_environment_id),
rv AS (SELECT source_environment_id AS sid, part, fold, actual, unnest(range(1, {len(RIDGE_COLUMNS) + 1})) AS i, unnest([{", ".join(RIDGE_COLUMNS)}]) AS x FROM rx),
rf AS (SELECT DISTINCT fold AS g FROM rx WHERE part = 'train' UNION ALL SELECT -1),
rb AS (SELECT g, rv.* FROM rf JOIN rv ON part = 'train' AND fold <> g),
rc AS (SELECT g, i, avg(x) AS m, stddev_pop(x) AS sd, avg(actual) AS y FROM rb GROUP BY g, i),
rz AS (SELECT g, sid, i, CASE WHEN sd > 1e-12 THEN (x - m) / sd ELSE 0 END AS z, actual - y AS yc FROM rb JOIN rc USING (g, i)),
rn AS (SELECT a.g, a.i, b.i AS j, sum(a.z * b.z) + CASE WHEN a.i = b.i THEN 10 ELSE 0 END AS c FROM rz a JOIN rz b USING (g, sid) GROUP BY a.g, a.i, b.i
  UNION ALL SELECT g, i, 1000, sum(z * yc) FROM rz GROUP BY g, i),
{solve_sql("rn", "rg")},
rp AS (SELECT g, sid, part, actual, greatest(0, max(y) + sum(CASE WHEN sd > 1e-12 THEN (x - m) / sd * sol[i] ELSE 0 END)) AS point
  FROM rv JOIN rc USING (i) JOIN rg USING (g) WHERE CASE WHEN part = 'train' THEN fold = g ELSE g = -1 END GROUP BY g, sid, part, actual)"""
CHOICE_SQL = f"""{RIDGE_SQL},
mr AS (SELECT 'role_mean' AS method, residual FROM ct
  UNION ALL SELECT 'unchanged_source', actual - source_rate - (SELECT avg(actual - source_rate) FROM ep WHERE part = 'train') FROM ep WHERE part = 'train'
  UNION ALL SELECT 'ridge', actual - point - (SELECT avg(actual - point) FROM rp WHERE part = 'train') FROM rp WHERE part = 'train'),
mp AS (SELECT 'role_mean' AS method, source_environment_id AS sid, actual, point FROM pr UNION ALL SELECT 'unchanged_source', source_environment_id, actual, source_rate FROM pr
  UNION ALL SELECT 'ridge', sid, actual, point FROM rp WHERE part = 'test'),
mq AS (SELECT method, sid, actual, point, quantile_cont(greatest(0, point + residual), 0.1) AS lo80, quantile_cont(greatest(0, point + residual), 0.9) AS hi80
  FROM mp JOIN mr USING (method) GROUP BY method, sid, actual, point),
mm AS (SELECT method, avg(abs(actual - point)) AS mae, avg(CASE WHEN actual BETWEEN lo80 AND hi80 THEN 1e0 ELSE 0 END) AS coverage, avg(hi80 - lo80) AS width FROM mq GROUP BY method),
mb AS (SELECT * FROM mm WHERE method <> 'ridge' ORDER BY mae, method LIMIT 1),
mo AS (SELECT mb.method AS other, list_filter([CASE WHEN o.mae > 1.10 * mb.mae THEN 'validation_point_error' END,
  CASE WHEN NOT o.coverage BETWEEN 0.65 AND 0.95 THEN 'validation_coverage' END, CASE WHEN o.width > 1.5 * mb.width THEN 'validation_width' END], lambda z: z IS NOT NULL) AS reasons
  FROM mm o, mb WHERE o.method = 'ridge')"""


@query(
    "method_choice",
    "K8",
    f"WITH RECURSIVE {CHOICE_SQL} SELECT CASE WHEN len(reasons) > 0 THEN other ELSE 'ridge' END AS method, array_to_string(reasons, ';') AS reasons FROM mo",
    "pm",
)
def method_choice(v):
    """Ridge against both baselines: which one passes the gates."""
    train, test = parts(v)
    rows = []
    columns, ridge, res = ridge_of(train)
    points = {
        "role_mean": (K.predict_role_mean(test, train), K.role_mean_residuals(train)),
        "unchanged_source": (K.predict_unchanged(test), K.unchanged_residuals(train)),
        "ridge": (ridge(K.design_columns(covariates(test), *columns)[0]), res),
    }
    for name, (point, residual) in points.items():
        scored = K.with_quantiles(
            point.select("actual", "point"), settle(residual, "residuals"), K.interval_probs()
        )
        rows.append(K.interval_metrics(scored).withColumn("method", F.lit(name)))
    table = settle(reduce(lambda a, b: a.unionByName(b), rows), "methods")
    out = K.choose_method(table, "ridge")
    return out.select("method", F.array_join("reasons", ";").alias("reasons"))


NUMERIC = ["source_rate", "log_minutes", "context_log_ratio", "changed_role"]


def covariates(rows):
    return rows.withColumns(
        {
            "log_minutes": F.log(F.col("source_minutes") / 900),
            "context_log_ratio": F.log(
                (F.col("destination_team_id") + 10) / (F.col("source_team_id") + 10)
            ),
            "changed_role": (F.col("role_change") != "same").cast("double"),
        }
    )


def ridge_of(train):
    rows, names = K.design_columns(covariates(train), NUMERIC, ROLES)
    rows = settle(rows, "design")
    return (NUMERIC, ROLES), K.fit_ridge(rows, names, "actual"), K.ridge_residuals(rows, names, "actual")


@query(
    "ridge_rate",
    "K5",
    f"WITH RECURSIVE {RIDGE_SQL} SELECT sid AS source_environment_id, round(actual, 6) AS actual, round(point, 6) AS point FROM rp WHERE part = 'test'",
    "pm",
)
def ridge_rate(v):
    train, test = parts(v)
    rows, names = K.design_columns(covariates(train), NUMERIC, ROLES)
    predict = K.fit_ridge(settle(rows, "design"), names, "actual")
    out = predict(K.design_columns(covariates(test), NUMERIC, ROLES)[0])
    return rounded(out.select("source_environment_id", "actual", "point"), "actual", "point")


POISSON_COLUMNS = [
    "1e0",
    "ln((source_passes + 0.5) / (source_minutes / 90e0 + 0.5))",
    *RIDGE_COLUMNS[1:4],
    *[f"CASE WHEN {side}_role = '{r}' THEN 1e0 ELSE 0 END" for side in ("source", "destination") for r in ROLES[:-1]],
]


def newton_sql(rows: str, penalty: float, steps: int, out: str) -> str:
    """``out``: g, sol - the log-rate fit of ``rows`` (sid, x list with a leading one, y, e) by Newton steps.

    The penalty is that of the mean log-likelihood weighted by the expected counts, whose sum
    is the sum of the counts at the optimum; the first coefficient is free.
    """
    parts = [f"{out}_0 AS (SELECT 0 AS g, list_transform(any_value(x), lambda z, i: CASE WHEN i = 1 THEN level ELSE 0 END) AS sol FROM {rows}, (SELECT ln(sum(y) / sum(e)) AS level FROM {rows}) q GROUP BY level)"]
    for step in range(1, steps + 1):
        name = f"{out}_{step}"
        parts += [
            f"{name}w AS MATERIALIZED (SELECT sid, x, list_dot_product(x, sol) AS eta, e * exp(list_dot_product(x, sol)) AS mu, y FROM {rows}, {out}_{step - 1})",
            f"{name}u AS MATERIALIZED (SELECT sid, mu, mu * eta + y - mu AS t, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS z FROM {name}w)",
            f"""{name}n AS MATERIALIZED (SELECT 0 AS g, a.i, b.i AS j, sum(a.mu * a.z * b.z) + CASE WHEN a.i = b.i AND a.i > 1 THEN {penalty} * (SELECT sum(y) FROM {rows}) ELSE 0 END AS c
  FROM {name}u a JOIN {name}u b USING (sid) GROUP BY a.i, b.i UNION ALL SELECT 0, i, 1000, sum(z * t) FROM {name}u GROUP BY i)""",
            solve_sql(f"{name}n", name),
        ]
    parts.append(f"{out} AS (SELECT * FROM {out}_{steps})")
    return ",\n".join(parts)


POISSON_SQL = f"""{EP_SQL},
gx AS (SELECT part, source_environment_id AS sid, [{", ".join(POISSON_COLUMNS)}] AS x, destination_passes AS y, destination_minutes / 90e0 AS e
  FROM (SELECT ep.*, x.team_id AS s_team, y.team_id AS d_team FROM ep JOIN env x ON x.environment_id = source_environment_id JOIN env y ON y.environment_id = destination_environment_id) q),
gt AS (SELECT * FROM gx WHERE part = 'train'),
{newton_sql("gt", 0.01, 9, "gp")}"""


@query(
    "poisson_rate",
    "K14",
    f"WITH RECURSIVE {POISSON_SQL} SELECT sid AS source_environment_id, round(exp(list_dot_product(x, sol)), 6) AS point FROM gx, gp WHERE part = 'test'",
    "pm",
)
def poisson_rate(v):
    train, test = parts(v)
    source_log = F.log((F.col("source_passes") + 0.5) / (F.col("source_minutes") / 90 + 0.5))
    shape = lambda d: K.design_columns(
        covariates(d).withColumns({"source_log": source_log, "exposure": F.col("destination_minutes") / 90}),
        ["source_log", "log_minutes", "context_log_ratio", "changed_role"], ROLES[:-1],
    )
    rows, names = shape(train)
    predict = K.fit_poisson(settle(rows, "design"), names, "destination_passes", "exposure")
    out = predict(shape(test)[0])
    return rounded(
        out.select("source_environment_id", (F.col("expected") / F.col("exposure")).alias("point")), "point"
    )


@query(
    "estimates",
    "K13",
    f"""WITH {EP_SQL} SELECT pr.source_environment_id, round(point, 5) AS point, {", ".join(f"round(quantile_cont(greatest(0, point + residual), {q}), 5) AS {n}" for n, q in {"p025": 0.025, "p10": 0.1, "p90": 0.9, "p975": 0.975}.items())}
FROM pr, ct GROUP BY pr.source_environment_id, point""",
    "pm",
)
def estimates(v):
    train, test = parts(v)
    point = K.predict_role_mean(test, train).select("source_environment_id", "point")
    return K.estimates(point, settle(K.role_mean_residuals(train), "residuals"))


@query(
    "change_description",
    "K15",
    f"""WITH {EP_SQL} SELECT destination_role, count(*) AS n, round(avg(actual - source_rate), 6) AS mean, round(stddev_samp(actual - source_rate), 6) AS sd,
 round(quantile_cont(actual - source_rate, 0.5), 6) AS median, round(quantile_cont(actual - source_rate, 0.1), 6) AS p10, round(quantile_cont(actual - source_rate, 0.9), 6) AS p90
FROM ep WHERE part = 'train' GROUP BY destination_role""",
    "pm",
)
def change_description(v):
    train, _ = parts(v)
    out = K.change_description(train, ["destination_role"])
    return rounded(out, "mean", "sd", "median", "p10", "p90")


@query(
    "holdout_table",
    "K16 K4",
    f"""WITH RECURSIVE {RIDGE_SQL} SELECT source_environment_id, round(pr.actual, 6) AS actual, round(pr.point, 6) AS role_mean,
 round(source_rate, 6) AS unchanged_source, round(rp.point, 6) AS ridge FROM pr JOIN rp ON sid = source_environment_id AND rp.part = 'test'""",
    "pm",
)
def holdout_table(v):
    train, test = parts(v)
    design, names = K.design_columns(covariates(train), NUMERIC, ROLES)
    ridge = K.fit_ridge(settle(design, "design"), names, "actual")
    methods = {
        "role_mean": K.predict_role_mean(test, train),
        "unchanged_source": K.predict_unchanged(test),
        "ridge": ridge(K.design_columns(covariates(test), NUMERIC, ROLES)[0]),
    }
    return rounded(K.holdout_table(methods, ["source_environment_id"]), "actual", *methods)


@query(
    "source_support",
    "K11",
    f"""WITH {EP_SQL}, b AS (SELECT min(source_rate) AS low, max(source_rate) AS high FROM ep WHERE part = 'train')
SELECT environment_id, array_to_string(list_filter([CASE WHEN minutes < 60 THEN 'below_60_reliable_minutes' END, CASE WHEN player_id % 50 = 0 THEN 'identity_quarantined' END,
  CASE WHEN passes IS NULL OR minutes <= 0 THEN 'missing_source_features' END, CASE WHEN season <> 1999 THEN 'outside_source_season' END,
  CASE WHEN minutes > 0 AND NOT (passes * 90 / minutes BETWEEN low AND high) THEN 'source_outside_development_range' END,
  CASE WHEN role NOT IN ('CB','CM','FB/WB','ST','W') THEN 'unsupported_source_role' END], lambda z: z IS NOT NULL), ';') AS exclusions FROM env, b""",
    "pm",
)
def source_support(v):
    train, _ = parts(v)
    rows = env(v).withColumn("quarantined", F.col("player_id") % 50 == 0)
    out = K.source_support(
        rows, K.development_bounds(train, "passes"), "passes", 1999, ["CB", "CM", "FB/WB", "ST", "W"], 60
    )
    return out.select("environment_id", F.array_join("exclusions", ";").alias("exclusions"))


@query(
    "scenario_grid",
    "K12",
    f"""WITH {EP_SQL}, tm AS (SELECT DISTINCT season, competition_id, team_id FROM env),
ro AS (SELECT unnest(['CB','CM','FB/WB','ST','W']) AS target_role),
dv AS (SELECT ep.*, x.team_id AS st, y.team_id AS dt FROM ep JOIN env x ON x.environment_id = source_environment_id JOIN env y ON y.environment_id = destination_environment_id WHERE part = 'train'),
di AS (SELECT st, dt, destination_role AS target_role, count(*) AS n FROM dv GROUP BY ALL), tl AS (SELECT dt, destination_role AS target_role, count(*) AS n FROM dv GROUP BY ALL),
rl AS (SELECT destination_role AS target_role, count(*) AS n FROM dv GROUP BY ALL),
g AS (SELECT e.role AS source_role, t.team_id AS target, ro.target_role, coalesce(di.n, 0) AS direct, coalesce(tl.n, 0) AS tr, coalesce(rl.n, 0) AS rn,
  e.minutes >= 60 AS sctx, t.team_id % 9 <> 0 AS tctx,
  CASE WHEN e.role = ro.target_role THEN 'same' WHEN least(e.role, ro.target_role) || '|' || greatest(e.role, ro.target_role) IN ('CB|FB/WB','CB|DM','CM|DM','AM|CM','AM|W','ST|W','FB/WB|W') THEN 'adjacent' ELSE 'major' END AS rc
  FROM env e JOIN tm t ON t.season = e.season AND t.competition_id = e.competition_id, ro
  LEFT JOIN di ON di.st = e.team_id AND di.dt = t.team_id AND di.target_role = ro.target_role
  LEFT JOIN tl ON tl.dt = t.team_id AND tl.target_role = ro.target_role LEFT JOIN rl ON rl.target_role = ro.target_role)
SELECT target AS target_team_id, target_role, CASE WHEN rc NOT IN ('same','adjacent') THEN 'out_of_scope' WHEN rn < 5 OR NOT sctx OR NOT tctx THEN 'insufficient_evidence' ELSE 'supported' END AS status,
 direct < 5 AS relies_on_pooling, count(*) AS scenarios, CAST(sum(direct) AS BIGINT) AS direct, CAST(sum(tr) AS BIGINT) AS team_role FROM g GROUP BY ALL""",
    "pm",
)
def scenario_grid(v):
    train, _ = parts(v)
    rows = settle(env(v), "environments")
    sources = rows.select(
        "season", "competition_id", F.col("team_id").alias("source_team_id"),
        F.col("role").alias("source_role"), (F.col("minutes") >= 60).alias("source_context"),
    )
    targets = rows.select("season", "competition_id", F.col("team_id").alias("target_team_id")).distinct()
    targets = targets.withColumn("target_context", F.col("target_team_id") % 9 != 0)
    grid = K.scenario_grid(
        sources, targets, train, ["season", "competition_id"], ["CB", "CM", "FB/WB", "ST", "W"]
    )
    return grid.groupBy("target_team_id", "target_role", "status", "relies_on_pooling").agg(
        F.count(F.lit(1)).alias("scenarios"),
        F.sum("direct_episodes").alias("direct"),
        F.sum("team_role_episodes").alias("team_role"),
    )


@query(
    "source_bootstrap",
    "K10",
    f"""WITH {ENV_SQL}, nr AS (SELECT player_id * 1000 + CAST(stint AS BIGINT) AS environment_id, passes, minutes,
  row_number() OVER (PARTITION BY player_id, stint ORDER BY observed_on, match_id) AS place, count(*) OVER (PARTITION BY player_id, stint) AS size FROM st WHERE reliable),
pk AS (SELECT g.draw, environment_id, CAST('0x' || substr(md5('src:' || g.draw || ':' || environment_id || ':' || place), 1, 15) AS BIGINT) % size + 1 AS place FROM nr, range(1, 6) g(draw)),
b AS (SELECT environment_id, draw, 90 * sum(passes) / sum(minutes) AS rate FROM pk JOIN nr USING (environment_id, place) GROUP BY ALL)
SELECT environment_id, round(avg(rate), 6) AS mean, round(max(rate), 6) AS high FROM b GROUP BY environment_id""",
    "pm",
)
def source_bootstrap(v):
    rows = numbered(v).where("reliable").withColumns(
        {
            "environment_id": (F.col("player_id") * 1000 + F.col("stint")).cast("bigint"),
            "day": F.unix_date("observed_on"),
        }
    )
    drawn = E.bootstrap_rates(rows, ["environment_id"], "day", "match_id", ["passes"], 5, "src")
    out = drawn.groupBy("environment_id").agg(
        F.avg("passes_per90").alias("mean"), F.max("passes_per90").alias("high")
    )
    return rounded(out, "mean", "high")


@query(
    "identity_status",
    "K1",
    """WITH r AS (SELECT l_orderkey AS player_id, p_name AS name, p_brand AS nationality, p_type AS gender FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT player_id, count(*) AS records, array_to_string(list_filter([CASE WHEN count(DISTINCT name) > 1 THEN 'conflicting_names' END,
 CASE WHEN count(DISTINCT nationality) > 1 THEN 'conflicting_nationality' END, CASE WHEN count(DISTINCT gender) > 1 THEN 'conflicting_gender' END], lambda z: z IS NOT NULL), ';') AS reasons,
 CASE WHEN count(DISTINCT name) > 1 OR count(DISTINCT nationality) > 1 OR count(DISTINCT gender) > 1 THEN 'quarantined' ELSE 'provider_id_consistent_metadata' END AS status FROM r GROUP BY player_id""",
)
def identity_status(v):
    rows = (
        v.table("lineitem")
        .join(v.table("part"), F.col("p_partkey") == F.col("l_partkey"))
        .select(
            F.col("l_orderkey").alias("player_id"), F.col("p_name").alias("name"),
            F.col("p_brand").alias("nationality"), F.col("p_type").alias("gender"),
        )
    )
    out = K.identity_status(rows, ["player_id"], ["nationality", "gender"])
    return out.withColumn("reasons", F.array_join("reasons", ";"))


@query(
    "identity_catalogue",
    "K2",
    "SELECT player_id, count(DISTINCT team_id) AS teams, count(DISTINCT season) AS seasons, count(DISTINCT competition_id) AS competitions, count(*) AS appearances FROM pm GROUP BY player_id",
    "pm",
)
def identity_catalogue(v):
    out = K.identity_catalogue(v.pm, ["player_id"])
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("teams", "seasons", "competitions")})


@query(
    "roster_members",
    "K3",
    """WITH r AS (SELECT DISTINCT match_id, team_id, player_id FROM lu)
SELECT team_id, player_id, count(DISTINCT match_id) AS matches FROM r GROUP BY ALL""",
    "lu",
)
def roster_members(v):
    sheet = F.struct(
        F.collect_list(F.when(F.col("starter"), F.col("player_id"))).alias("lineup"),
        F.collect_list(F.when(~F.col("starter"), F.col("player_id"))).alias("bench"),
        F.collect_list(
            F.when(~F.col("starter"), F.struct(F.col("player_id").alias("enters"), F.col("player_id").alias("leaves")))
        ).alias("substitutions"),
    )
    teams = v.lu.groupBy("match_id", "team_id").agg(sheet.alias("sheet"))
    matches = teams.groupBy("match_id").agg(
        F.map_from_entries(F.collect_list(F.struct("team_id", "sheet"))).alias("teams")
    ).withColumns({"competition_id": F.lit(0), "season": F.lit(0)})
    out = K.roster_members(matches)
    return out.groupBy("team_id", "player_id").agg(F.count(F.lit(1)).alias("matches"))
