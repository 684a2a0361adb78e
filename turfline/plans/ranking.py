"""Ranking queries: J1-J23."""

from __future__ import annotations

from pyspark.sql import functions as F

from turfline.operators import evaluation as E
from turfline.operators import profiles as P
from turfline.operators import scenario as J
from turfline.operators.ordering import value_ladder, with_midrank, with_reference_midrank
from turfline.plans.evaluation import BOOT_SQL, DRAWS, METRIC_SQL, PAIR_SQL, boot, paired_players, ranks
from turfline.plans.profiles import LONG_CO, RATES, rounded
from turfline.plans.registry import query
from turfline.plans.similarity import FAM, FAMILY_CASE
from turfline.session import settle

ROLES = ["CB", "FB/WB", "CM", "W", "ST"]


def candidate_index(v):
    """Percentiles map, stability, clubs, eligibility."""
    long = with_midrank(
        P.melt(v.co, ["player_id", "primary_role"], RATES), ["primary_role", "feature"], "value", "pct"
    )
    maps = long.groupBy("player_id").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "pct"))).alias("percentiles")
    )
    pid = F.col("player_id")
    return v.co.join(maps, "player_id").select(
        "player_id",
        F.col("primary_role").alias("role"),
        "minutes",
        F.array("club_id").alias("team_ids"),
        (pid % 17 != 0).alias("eligible"),
        F.when(pid % 17 == 0, F.array(F.lit("uncertain_role"))).otherwise(F.array().cast("array<string>")).alias("exclusions"),
        F.when(pid % 10 != 9, (pid % 10) / 10.0).alias("neighbour_stability"),
        "percentiles",
    )


def scenarios_of(v):
    n = F.col("n_nationkey").cast("bigint")
    return v.table("nation").select(
        n.alias("scenario_id"),
        n.alias("club_id"),
        F.element_at(F.array(*[F.lit(r) for r in ROLES]), (n % 5 + 1).cast("int")).alias("target_role"),
        (300 + 20 * (n % 5)).cast("double").alias("minimum_minutes"),
        F.when(n % 4 == 0, 0.2).otherwise(0.0).alias("minimum_stability"),
        (n % 2 == 0).alias("exclude_same_club"),
        F.when(n % 7 == 6, (n + 1) % 25).alias("candidate_team_id"),
        F.when(n % 6 == 5, n * 13).alias("replacement_player_id"),
    )


# Requirements by rule: feature, preference, value, weight, hard (SQL over n).
NEEDS = [
    ("shots_per90", "minimum", "60", "3", "FALSE"),
    ("passes_per90", "exact", "50 + n", "2", "FALSE"),
    ("pressures_per90", "maximum", "80", "1", "FALSE"),
    ("tackles_per90", "neutral", "50", "2", "FALSE"),
    ("carries_per90", "minimum", "40", "1", "n % 5 = 0"),
]


def requirements_of(v):
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature_id"),
                F.lit(FAM[f]).alias("family"),
                F.lit(p).alias("preference"),
                F.expr(x.replace("n", "n_nationkey")).cast("double").alias("value"),
                F.lit(float(w)).alias("weight"),
                F.expr(h.replace("n ", "n_nationkey ")).alias("hard_constraint"),
                F.lit(2.0 if FAM[f] == "defending" else 1.0).alias("family_weight"),
            )
            for f, p, x, w, h in NEEDS
        ]
    )
    return v.table("nation").select(
        F.col("n_nationkey").cast("bigint").alias("scenario_id"), F.explode(rows).alias("r")
    ).select("scenario_id", "r.*")


def inputs(v):
    return scenarios_of(v), requirements_of(v), settle(candidate_index(v), "candidates")


PCT_SQL = f"""l AS ({LONG_CO}),
pc AS (SELECT player_id, primary_role, feature, 100 * (rank() OVER (PARTITION BY primary_role, feature ORDER BY value) - 1
  + 0.5e0 * count(*) OVER (PARTITION BY primary_role, feature, value)) / count(*) OVER (PARTITION BY primary_role, feature) AS pct FROM l)"""
LOSS = """CASE preference WHEN 'neutral' THEN 0e0 WHEN 'minimum' THEN greatest(0e0, target - pct) WHEN 'maximum' THEN greatest(0e0, pct - target) ELSE abs(pct - target) END"""
RANK_SQL = f"""{PCT_SQL},
sc AS (SELECT n AS scenario_id, n AS club_id, list_extract(['CB','FB/WB','CM','W','ST'], CAST(n % 5 + 1 AS INT)) AS target_role, 300e0 + 20 * (n % 5) AS minimum_minutes,
  CASE WHEN n % 4 = 0 THEN 0.2e0 ELSE 0 END AS minimum_stability, n % 2 = 0 AS exclude_same_club, CASE WHEN n % 7 = 6 THEN (n + 1) % 25 END AS candidate_team_id,
  CASE WHEN n % 6 = 5 THEN n * 13 END AS replacement_player_id FROM (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation) q),
rq AS ({" UNION ALL ".join(f"SELECT n AS scenario_id, '{f}' AS feature, '{FAM[f]}' AS family, '{p}' AS preference, CAST({x} AS DOUBLE) AS target, {float(w)}e0 * {2 if FAM[f] == 'defending' else 1} AS weight, {h} AS hard FROM (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation) q" for f, p, x, w, h in NEEDS)}),
cd AS (SELECT player_id, primary_role AS role, minutes, club_id AS team, player_id % 17 <> 0 AS eligible,
  CASE WHEN player_id % 10 <> 9 THEN (player_id % 10) / 10e0 END AS stab FROM co),
pl AS (SELECT s.scenario_id, c.player_id, r.feature, r.family, r.preference, r.weight, {LOSS} AS loss, r.hard
  FROM sc s JOIN cd c ON c.role = s.target_role JOIN rq r ON r.scenario_id = s.scenario_id AND r.preference <> 'neutral'
  JOIN pc ON pc.player_id = c.player_id AND pc.feature = r.feature),
jd AS (SELECT s.scenario_id, c.player_id, array_to_string(list_sort(list_filter([CASE WHEN NOT eligible THEN 'uncertain_role' END,
  CASE WHEN minutes < minimum_minutes THEN 'below_minutes' END,
  CASE WHEN minimum_stability > 0 AND (stab IS NULL OR stab < minimum_stability) THEN 'below_evidence_threshold' END,
  CASE WHEN exclude_same_club AND team = club_id THEN 'same_club_excluded' END,
  CASE WHEN candidate_team_id IS NOT NULL AND team <> candidate_team_id THEN 'candidate_team_filter' END,
  CASE WHEN c.player_id = replacement_player_id THEN 'replacement_reference' END,
  CASE WHEN EXISTS (SELECT 1 FROM pl WHERE pl.scenario_id = s.scenario_id AND pl.player_id = c.player_id AND hard AND loss > 1e-9) THEN 'hard_feature_constraint:carries_per90' END],
  lambda z: z IS NOT NULL)), ';') AS reasons FROM sc s JOIN cd c ON c.role = s.target_role),
el AS (SELECT pl.* FROM pl JOIN jd USING (scenario_id, player_id) WHERE reasons = ''),
ds AS (SELECT scenario_id, player_id, sqrt(sum(weight * loss * loss) / sum(weight)) AS distance, sum(weight * loss * loss) AS sq,
  count(*) FILTER (WHERE loss > CASE WHEN preference = 'exact' THEN 10 ELSE 1e-9 END) AS unmet,
  sum(CASE WHEN loss > CASE WHEN preference = 'exact' THEN 10 ELSE 1e-9 END THEN weight ELSE 0 END) / sum(weight) AS unmet_share FROM el GROUP BY ALL),
rn AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY floor(distance * 1e6 + 0.5) / 1e6, player_id) AS rank FROM ds)"""


@query(
    "candidate_index",
    "J9",
    f"""WITH {PCT_SQL} SELECT player_id, string_agg(feature || '=' || CAST(CAST(floor(pct * 10 + 0.5) AS INT) AS VARCHAR), ',' ORDER BY feature) AS percentiles
FROM pc GROUP BY player_id""",
    "co",
)
def candidate_index_query(v):
    entries = F.array_sort(F.map_entries("percentiles"))
    text = F.transform(
        entries, lambda e: F.concat_ws("=", e["key"], J.quantised(e["value"]).cast("string"))
    )
    return candidate_index(v).select("player_id", F.array_join(text, ",").alias("percentiles"))


@query(
    "filter_reasons",
    "J5",
    f"WITH {RANK_SQL} SELECT scenario_id, player_id, reasons FROM jd",
    "co",
)
def filter_reasons(v):
    s, r, c = inputs(v)
    out = J.judge(s, J.packed_requirements(r), c)
    return out.select("scenario_id", "player_id", F.array_join("reasons", ";").alias("reasons"))


@query(
    "filter_reasons_all_roles",
    "J5",
    f"""WITH {RANK_SQL} SELECT s.scenario_id, c.role <> s.target_role AS wrong_role, count(*) AS players FROM sc s JOIN cd c ON TRUE GROUP BY ALL""",
    "co",
)
def filter_reasons_all_roles(v):
    s, r, c = inputs(v)
    out = J.judge(s, J.packed_requirements(r), c, ROLES)
    return out.groupBy("scenario_id", F.array_contains("reasons", "wrong_role").alias("wrong_role")).agg(
        F.count(F.lit(1)).alias("players")
    )


@query(
    "rank_scenarios",
    "J1 J2 J3 J4 J7",
    f"WITH {RANK_SQL} SELECT scenario_id, player_id, rank, round(distance, 6) AS distance FROM rn",
    "co",
)
def rank_scenarios(v):
    rankings, _, _ = J.rank_scenarios(*inputs(v))
    return rounded(rankings.select("scenario_id", "player_id", "rank", "distance"), "distance")


@query(
    "rank_details",
    "J3 J7",
    f"""WITH {RANK_SQL}, e AS (SELECT el.*, sq, weight * loss * loss AS c,
  row_number() OVER (PARTITION BY scenario_id, player_id ORDER BY loss, feature) AS b FROM el JOIN ds USING (scenario_id, player_id)),
w AS (SELECT scenario_id, player_id, feature, row_number() OVER (PARTITION BY scenario_id, player_id ORDER BY -c, feature) AS o FROM e WHERE loss > 1e-9),
g AS (SELECT scenario_id, player_id, string_agg(feature, ',' ORDER BY o) AS main_mismatches FROM w WHERE o <= 3 GROUP BY ALL)
SELECT e.scenario_id, e.player_id, string_agg(CASE WHEN b <= 3 THEN feature END, ',' ORDER BY b) AS strong_matches, coalesce(min(main_mismatches), '') AS main_mismatches,
 round(sum(CASE WHEN family = 'passing' AND sq > 0 THEN c / sq ELSE 0 END), 6) AS passing_share
FROM e LEFT JOIN g ON g.scenario_id = e.scenario_id AND g.player_id = e.player_id GROUP BY e.scenario_id, e.player_id""",
    "co",
)
def rank_details(v):
    rankings, _, _ = J.rank_scenarios(*inputs(v))
    passing = J.family_contributions(rankings).where(F.col("family") == "passing")
    return rankings.join(passing, ["scenario_id", "player_id"]).select(
        "scenario_id",
        "player_id",
        F.array_join("strong_matches", ",").alias("strong_matches"),
        F.array_join("main_mismatches", ",").alias("main_mismatches"),
        F.round("share", 6).alias("passing_share"),
    )


@query(
    "scenario_status",
    "J7",
    f"""WITH {RANK_SQL} SELECT s.scenario_id, CASE WHEN count(d.player_id) = 0 THEN 'no_candidates' ELSE 'ok' END AS status, count(d.player_id) AS eligible_count,
 4 AS active_requirements FROM sc s LEFT JOIN ds d USING (scenario_id) GROUP BY s.scenario_id""",
    "co",
)
def scenario_status(v):
    return J.rank_scenarios(*inputs(v))[2]


def scored_of(v):
    s, r, c = inputs(v)
    return J.score(J.judge(s, J.packed_requirements(r), c)), r


@query(
    "order_keys",
    "J4",
    f"""WITH {RANK_SQL} SELECT scenario_id, player_id, round(unmet * 1000 + floor(distance * 1e6 + 0.5) / 1e6, 6) AS hybrid, round(unmet_share, 6) AS satisfaction FROM ds""",
    "co",
)
def order_keys(v):
    rows, _ = scored_of(v)
    return rows.select(
        "scenario_id",
        "player_id",
        F.round(J.order_value("hybrid"), 6).alias("hybrid"),
        F.round(J.order_value("satisfaction"), 6).alias("satisfaction"),
    )


@query(
    "family_rms",
    "J2 J4",
    f"""WITH {RANK_SQL}, fw AS (SELECT scenario_id, feature, weight / sum(weight) OVER (PARTITION BY scenario_id, family) * CASE WHEN family = 'defending' THEN 2 ELSE 1 END AS w
  FROM rq WHERE preference <> 'neutral')
SELECT scenario_id, player_id, round(sqrt(sum(w * loss * loss) / sum(w)), 6) AS distance FROM el JOIN fw USING (scenario_id, feature) GROUP BY ALL""",
    "co",
)
def family_rms(v):
    s, r, c = inputs(v)
    rows = J.score(J.judge(s, J.packed_requirements(J.family_rms_weights(r)), c))
    return rounded(rows.select("scenario_id", "player_id", "distance"), "distance")


@query(
    "pareto_frontier",
    "J6",
    f"""WITH {RANK_SQL}, v AS (SELECT scenario_id, player_id, list(loss ORDER BY feature) AS x FROM el GROUP BY ALL)
SELECT a.scenario_id, a.player_id FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.scenario_id = a.scenario_id AND b.player_id <> a.player_id
  AND b.x[1] <= a.x[1] + 1e-9 AND b.x[2] <= a.x[2] + 1e-9 AND b.x[3] <= a.x[3] + 1e-9 AND b.x[4] <= a.x[4] + 1e-9
  AND (b.x[1] < a.x[1] - 1e-9 OR b.x[2] < a.x[2] - 1e-9 OR b.x[3] < a.x[3] - 1e-9 OR b.x[4] < a.x[4] - 1e-9))""",
    "co",
)
def pareto_frontier(v):
    rows, _ = scored_of(v)
    return J.pareto_frontier(rows, ["scenario_id"], "player_id")


@query(
    "scenario_validation",
    "J8",
    """WITH s AS (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation)
SELECT n AS scenario_id, array_to_string(list_filter([CASE WHEN n >= 20 THEN 'unknown_club' END, CASE WHEN n % 6 = 5 THEN 'invalid_replacement_reference' END,
 CASE WHEN n > 22 THEN 'value_outside_percentiles' END], lambda z: z IS NOT NULL), ';') AS reasons FROM s WHERE n >= 20 OR n % 6 = 5""",
)
def scenario_validation(v):
    s = scenarios_of(v).withColumn("candidate_team_id", F.lit(None).cast("bigint"))
    r = requirements_of(v).withColumn(
        "value", F.when(F.col("scenario_id") > 22, F.col("value") + 100).otherwise(F.col("value"))
    )
    clubs = v.table("nation").where("n_nationkey < 20").select(
        F.col("n_nationkey").cast("bigint").alias("club_id")
    )
    people = v.table("customer").select(
        F.col("c_custkey").alias("player_id"), F.lit(False).alias("eligible"),
        F.array(F.col("c_nationkey").cast("bigint")).alias("team_ids"), F.lit("CB").alias("role"),
    )
    out = J.validate_scenarios(s, r, clubs, people)
    return out.select("scenario_id", F.array_join("reasons", ";").alias("reasons"))


@query(
    "replacement_requirements",
    "J10",
    f"WITH {PCT_SQL} SELECT player_id, feature AS feature_id, 'exact' AS preference, round(pct, 6) AS value, 1e0 AS weight, FALSE AS hard_constraint FROM pc",
    "co",
)
def replacement_requirements(v):
    return rounded(J.replacement_requirements(candidate_index(v), ["player_id"]), "value")


UNI = "0.8e0 + 0.4e0 * CAST('0x' || substr(md5('w:' || g.draw || ':' || feature), 1, 15) AS BIGINT) / 1152921504606846976e0"
STAB_SQL = f"""{RANK_SQL},
df AS (SELECT scenario_id, player_id, g.draw, sqrt(sum(weight * ({UNI}) * loss * loss) / sum(weight * ({UNI}))) AS distance FROM el, range(1, 11) g(draw) GROUP BY ALL),
dr AS (SELECT *, row_number() OVER (PARTITION BY scenario_id, draw ORDER BY floor(distance * 1e6 + 0.5) / 1e6, player_id) AS drank FROM df),
sz AS (SELECT scenario_id, least(10, count(*)) AS k FROM rn GROUP BY scenario_id)"""


@query(
    "weight_draws",
    "J11",
    f"""WITH {RANK_SQL} SELECT scenario_id, feature AS feature_id, CAST(g.draw AS INT) AS draw, round(weight * ({UNI}), 6) AS weight FROM rq, range(1, 11) g(draw)""",
    "co",
)
def weight_draws(v):
    out = J.perturbed_requirements(requirements_of(v), 10, "w").withColumn(
        "weight", F.col("weight") * F.col("family_weight")
    )
    return rounded(out.select("scenario_id", "feature_id", "draw", "weight"), "weight")


@query(
    "rank_weights_stability",
    "J11 J12 J13",
    f"""WITH {STAB_SQL}, c AS (SELECT d.scenario_id, d.draw, count(*) FILTER (WHERE drank <= k AND rank <= k) AS common, min(k) AS k
  FROM dr d JOIN rn USING (scenario_id, player_id) JOIN sz USING (scenario_id) GROUP BY ALL)
SELECT scenario_id, round(avg(common / (2e0 * k - common)), 6) AS mean_jaccard FROM c GROUP BY scenario_id""",
    "co",
)
def rank_weights_stability(v):
    rows, r = scored_of(v)
    return rounded(J.weight_stability(rows, r, 10, "w")[0], "mean_jaccard")


@query(
    "rank_spread",
    "J12",
    f"""WITH {STAB_SQL} SELECT scenario_id, player_id, round(avg(CASE WHEN drank <= k THEN 1e0 ELSE 0 END), 6) AS top_k_inclusion,
 round(quantile_cont(drank, 0.1), 6) AS rank_p10, round(quantile_cont(drank, 0.9), 6) AS rank_p90 FROM dr JOIN sz USING (scenario_id) GROUP BY ALL""",
    "co",
)
def rank_spread(v):
    rows, r = scored_of(v)
    return rounded(J.weight_stability(rows, r, 10, "w")[1], "top_k_inclusion", "rank_p10", "rank_p90")


@query(
    "bootstrap_percentiles",
    "J14 H8",
    f"""WITH {BOOT_SQL.replace(f'range(1, {DRAWS + 1})', 'range(1, 6)')}
SELECT CAST(draw AS INT) AS draw, player_id, CAST(floor((100 * ((SELECT count(*) FROM co r WHERE r.primary_role = c.primary_role AND r.passes_per90 < b.passes_per90)
 + 0.5e0 * (SELECT count(*) FROM co r WHERE r.primary_role = c.primary_role AND r.passes_per90 = b.passes_per90))
 / (SELECT count(*) FROM co r WHERE r.primary_role = c.primary_role)) * 10 + 0.5) AS INT) AS tenths FROM bs b JOIN co c USING (player_id)""",
    "co",
)
def bootstrap_percentiles(v):
    drawn = boot(v, 5).join(v.co.select("player_id", "primary_role"), "player_id")
    probes = settle(
        drawn.select("draw", "player_id", "primary_role", F.col("passes_per90").alias("value")), "draws"
    )
    reference = v.co.select("primary_role", F.col("passes_per90").alias("value"))
    out = with_reference_midrank(probes, reference, ["primary_role"], "value", "pct")
    return out.select("draw", "player_id", J.quantised(F.col("pct")).alias("tenths"))


PROFILE_SQL = f"""{RANK_SQL}, {BOOT_SQL.replace(f'range(1, {DRAWS + 1})', 'range(1, 6)')},
bw AS ({" UNION ALL ".join(f"SELECT draw, player_id, '{c}' AS feature, {c} AS value FROM bs" for c in RATES)}),
bp AS (SELECT b.draw, b.player_id, b.feature, floor(100 * (count(*) FILTER (WHERE r.value < b.value) + 0.5e0 * count(*) FILTER (WHERE r.value = b.value)) / count(*) * 10 + 0.5) / 10e0 AS pct
  FROM bw b JOIN co c USING (player_id) JOIN l r ON r.primary_role = c.primary_role AND r.feature = b.feature GROUP BY b.draw, b.player_id, b.feature),
dp AS (SELECT s.scenario_id, s.target_role, p.draw, c.player_id, r.weight, {LOSS} AS loss, r.hard FROM sc s JOIN cd c ON c.role = s.target_role
  JOIN rq r ON r.scenario_id = s.scenario_id AND r.preference <> 'neutral' JOIN bp p ON p.player_id = c.player_id AND p.feature = r.feature),
dw AS (SELECT scenario_id, draw, player_id, sqrt(sum(weight * loss * loss) / sum(weight)) AS distance FROM dp JOIN jd USING (scenario_id, player_id)
  WHERE reasons IN ('', 'hard_feature_constraint:carries_per90') GROUP BY ALL HAVING NOT bool_or(hard AND loss > 1e-9)),
dq AS (SELECT *, row_number() OVER (PARTITION BY scenario_id, draw ORDER BY floor(distance * 1e6 + 0.5) / 1e6, player_id) AS drank FROM dw),
dk AS (SELECT scenario_id, least(count(*), 10) AS k FROM rn GROUP BY scenario_id),
dc AS (SELECT k.scenario_id, g.draw, k.k, count(q.player_id) AS common FROM dk k CROSS JOIN range(1, 6) g(draw)
  LEFT JOIN (SELECT d.scenario_id, d.draw, d.player_id, d.drank, rn.rank FROM dq d JOIN rn USING (scenario_id, player_id)) q
  ON q.scenario_id = k.scenario_id AND q.draw = g.draw AND q.drank <= k.k AND q.rank <= k.k GROUP BY ALL),
dj AS (SELECT scenario_id, avg(common / CAST(2 * k - common AS DOUBLE)) AS mean_jaccard FROM dc GROUP BY scenario_id)"""


@query(
    "profile_bootstrap_ranking",
    "J13",
    f"""WITH {PROFILE_SQL} SELECT target_role, count(*) AS scenarios, round(avg(mean_jaccard), 6) AS mean_jaccard FROM dj JOIN sc USING (scenario_id) GROUP BY ROLLUP (target_role)""",
    "co",
)
def profile_bootstrap_ranking(v):
    """Rank stability of every scenario under profile bootstraps, by target role."""
    s, r, c = inputs(v)
    drawn = boot(v, 5).join(v.co.select("player_id", "primary_role"), "player_id")
    probes = settle(P.melt(drawn, ["draw", "player_id", "primary_role"], RATES), "draws")
    reference = P.melt(v.co, ["primary_role"], RATES)
    pct = with_reference_midrank(probes, reference, ["primary_role", "feature"], "value", "pct")
    maps = pct.groupBy("draw", "player_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct("feature", (J.quantised(F.col("pct")) / 10.0).alias("p")))
        ).alias("percentiles")
    )
    needs = J.packed_requirements(r)
    reference_rank = J.score(J.judge(s, needs, c))
    redrawn = J.score(J.judge(s, needs, c.drop("percentiles").join(maps, "player_id")))
    from turfline.operators.ordering import row_index

    base = row_index(
        settle(reference_rank.withColumn("_o", J.order_value("weighted_rms")).select("scenario_id", "player_id", "_o", "target_role"), "base"),
        ["scenario_id"], "_o", "player_id", "rank",
    )
    other = row_index(
        settle(redrawn.withColumn("_o", J.order_value("weighted_rms")).select("scenario_id", "draw", "player_id", "_o"), "redrawn"),
        ["scenario_id", "draw"], "_o", "player_id", "rank",
    )
    overlaps, _ = J.rank_summary(base, other, ["scenario_id"], "player_id", 10, 5)
    summary = overlaps.join(s.select("scenario_id", "target_role"), "scenario_id")
    return rounded(
        summary.rollup("target_role").agg(
            F.count(F.lit(1)).alias("scenarios"), F.avg("mean_jaccard").alias("mean_jaccard")
        ),
        "mean_jaccard",
    )


@query(
    "loo_context",
    "J15",
    """WITH t AS (SELECT club_id, sum(passes) AS p, sum(minutes) AS m FROM pm GROUP BY club_id), o AS (SELECT club_id, player_id, sum(passes) AS p, sum(minutes) AS m FROM pm GROUP BY ALL)
SELECT o.club_id, o.player_id, greatest(0, t.p - o.p) AS passes, greatest(0, t.m - o.m) AS minutes FROM o JOIN t USING (club_id)""",
    "pm",
)
def loo_context(v):
    own = v.pm.groupBy("club_id", "player_id").agg(
        F.sum("passes").alias("passes"), F.sum("minutes").alias("minutes")
    )
    totals = own.groupBy("club_id").agg(
        F.sum("passes").alias("passes"), F.sum("minutes").alias("minutes")
    )
    return J.leave_one_out(totals, own, ["club_id"], "player_id", ["passes", "minutes"])


@query(
    "temporal_peers",
    "J19",
    f"""WITH {PAIR_SQL}, r AS (SELECT 'weighted_rms' AS method, primary_role, rank, candidates FROM rk)
SELECT method, primary_role, count(*) AS queries, round(avg(1e0 / rank), 6) AS mrr, round(avg(CASE WHEN candidates > 1 THEN 1 - (rank - 1) / CAST(candidates - 1 AS DOUBLE) END), 6) AS rank_percentile,
 round(avg(candidates), 6) AS mean_candidates FROM r GROUP BY ROLLUP (method, primary_role)""",
    "pm",
)
def temporal_peers(v):
    rows = ranks(v).withColumn("method", F.lit("weighted_rms"))
    out = J.metric_rollup(rows, ["method", "primary_role"])
    return rounded(out, "mrr", "rank_percentile", "mean_candidates")


@query(
    "roster_holdout",
    "J17",
    """SELECT a.player_id, a.club_id, a.primary_role, round(quantile_cont(b.passes_per90, 0.5), 6) AS mates_median FROM co a JOIN co b
 ON a.club_id = b.club_id AND a.primary_role = b.primary_role AND a.player_id <> b.player_id GROUP BY ALL""",
    "co",
)
def roster_holdout(v):
    keys = ["club_id", "primary_role"]
    rows = v.co.select("player_id", *keys, F.col("passes_per90").alias("value"))
    ladder = settle(value_ladder(rows, keys, "value"), "ladder")
    out = J.holdout_medians(ladder, rows, keys, "value")
    return rounded(out.drop("value"), "mates_median")


@query(
    "reconstruction",
    "I5",
    f"""WITH {PAIR_SQL}, rec_cf AS (SELECT player_id, primary_role, feature, value, family FROM (SELECT *, {FAMILY_CASE} AS family FROM ({LONG_CO}) v) q),
rec_sm AS (SELECT primary_role, feature, family, avg(value) AS m, stddev_pop(value) AS sd FROM rec_cf GROUP BY ALL),
rec_sw AS (SELECT *, 1e0 / (5 * count(*) OVER (PARTITION BY primary_role, family)) AS w FROM rec_sm),
rec_pc AS (SELECT player_id, primary_role, feature, w, (value - m) / sd AS z, 100e0 * (rank() OVER (PARTITION BY primary_role, feature ORDER BY value) - 1
  + count(*) OVER (PARTITION BY primary_role, feature, value) / 2e0) / count(*) OVER (PARTITION BY primary_role, feature) AS p FROM rec_cf JOIN rec_sw USING (primary_role, feature)),
rec_dd AS (SELECT a.player_id, b.player_id AS other, sqrt(sum(a.w * pow(a.z - b.z, 2))) AS near, sqrt(sum(pow(a.p - b.p, 2))) AS ranked
  FROM rec_pc a JOIN rec_pc b ON a.primary_role = b.primary_role AND a.feature = b.feature AND a.player_id <> b.player_id GROUP BY ALL),
rec_tt AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY near, other) AS i, row_number() OVER (PARTITION BY player_id ORDER BY ranked, other) AS j FROM rec_dd)
SELECT player_id, round(count(*) FILTER (WHERE i <= 10 AND j <= 10) / CAST(count(*) FILTER (WHERE i <= 10 OR j <= 10) AS DOUBLE), 6) AS jaccard
FROM rec_tt WHERE player_id IN (SELECT player_id FROM ok) GROUP BY player_id""",
    "co",
)
def reconstruction(v):
    """How far ranking by a player's own percentiles finds its neighbours again."""
    from turfline.operators import similarity as S

    asked = paired_players(v).select("player_id")
    index = settle(candidate_index(v).select("player_id", "role", "percentiles"), "index")
    vec = F.transform(F.array(*[F.lit(f) for f in sorted(RATES)]), lambda f: F.element_at("percentiles", f))
    points = index.select("player_id", F.col("role").alias("primary_role"), vec.alias("vec"))
    ranked = S.nearest(points, ["primary_role"], "player_id", 10, centre=50.0)
    scaler = settle(S.fit_scaling(v.co, ["primary_role"], FAM, "standard"), "scaler")
    near = S.nearest(S.standardise(v.co, scaler, ["primary_role"], RATES), ["primary_role"], "player_id", 10)
    both = E.overlap(near, ranked, ["player_id"], []).join(asked, "player_id", "left_semi")
    return rounded(both.select("player_id", "jaccard"), "jaccard")


@query(
    "method_selection",
    "I2",
    f"""WITH {PAIR_SQL}, m AS (SELECT primary_role AS method, {METRIC_SQL}, avg(list_sum(list_transform(range(1, candidates + 1), lambda i: 1e0 / i)) / candidates) AS random_mrr,
  CASE WHEN primary_role = 'CB' THEN 0.5 ELSE 0.8 END AS jaccard FROM rk GROUP BY primary_role)
SELECT (SELECT method FROM m WHERE mrr > random_mrr AND jaccard >= 0.65 ORDER BY list_position(['CB', 'W', 'ST', 'CM', 'FB/WB'], method) LIMIT 1) AS method""",
    "pm",
)
def method_selection(v):
    rows = ranks(v)
    summary = E.retrieval_metrics(rows, ["primary_role"]).join(
        E.random_expectation(rows, ["primary_role"]), "primary_role"
    )
    table = summary.select(
        F.col("primary_role").alias("method"), F.round("mrr", 6).alias("mrr"), "random_mrr",
        F.when(F.col("primary_role") == "CB", 0.5).otherwise(0.8).alias("jaccard"),
    )
    return J.select_method(table, ["CB", "W", "ST", "CM", "FB/WB"])


@query(
    "native_ranking",
    "J22",
    """WITH v AS (SELECT player_id, primary_role, competition_id, 'passes_per90' AS feature, passes_per90 AS value FROM co UNION ALL SELECT player_id, primary_role, competition_id, 'shots_per90', shots_per90 FROM co),
s AS (SELECT feature, stddev_pop(value) AS scale FROM v GROUP BY feature),
n AS (SELECT primary_role AS scenario_id, feature, quantile_cont(value, 0.5) AS target, CASE WHEN feature = 'shots_per90' THEN 'at_least' ELSE 'near' END AS mode, CASE WHEN feature = 'shots_per90' THEN 2e0 ELSE 1e0 END AS weight FROM v GROUP BY ALL)
SELECT n.scenario_id, player_id, min(competition_id) AS league, round(sqrt(sum(weight * pow(CASE WHEN mode = 'at_least' THEN greatest(0, (target - value) / scale) ELSE abs(value - target) / scale END, 2)) / sum(weight)), 6) AS distance
FROM v JOIN n ON n.scenario_id = v.primary_role AND n.feature = v.feature JOIN s ON s.feature = v.feature GROUP BY n.scenario_id, player_id""",
    "co",
)
def native_ranking(v):
    features = ["passes_per90", "shots_per90"]
    rows = settle(
        P.melt(v.co, ["player_id", "primary_role", "competition_id"], features).select(
            F.col("primary_role").alias("scenario_id"), "player_id",
            F.col("competition_id").alias("league"), "feature", "value",
        ),
        "native",
    )
    scales = rows.groupBy("feature").agg(F.stddev_pop("value").alias("scale"))
    from turfline.operators.ordering import group_quantiles

    needs = group_quantiles(rows, ["scenario_id", "feature"], "value", {"target": 0.5}).withColumns(
        {
            "mode": F.when(F.col("feature") == "shots_per90", "at_least").otherwise("near"),
            "weight": F.when(F.col("feature") == "shots_per90", 2.0).otherwise(1.0),
        }
    )
    return rounded(J.native_ranking(rows, needs, scales, ["scenario_id"]), "distance")


@query(
    "asof_universe",
    "J23",
    """WITH d AS (SELECT DISTINCT CAST(date_trunc('year', o_orderdate) AS DATE) AS decision FROM orders)
SELECT player_id, decision, sum(minutes) AS minutes, CAST(count(*) AS DOUBLE) AS appearances, sum(passes) AS passes FROM pm JOIN d ON observed_on <= decision WHERE reliable GROUP BY ALL""",
    "pm",
)
def asof_universe(v):
    days = v.table("orders").select(F.trunc(F.to_date("o_orderdate"), "year").alias("decision_date")).distinct()
    return J.asof_universe(v.pm, days, "player_id", ["passes"])


@query(
    "filter_reasons_full",
    "J5 J7",
    f"""WITH {RANK_SQL},
hx AS (SELECT r.scenario_id, pc.player_id FROM rq r JOIN pc ON pc.feature = r.feature WHERE hard AND preference <> 'neutral' AND {LOSS} > 1e-9)
SELECT s.scenario_id, c.player_id, array_to_string(list_sort(list_filter([CASE WHEN NOT eligible THEN 'uncertain_role' END, CASE WHEN c.role <> s.target_role THEN 'wrong_role' END,
  CASE WHEN minutes < minimum_minutes THEN 'below_minutes' END,
  CASE WHEN minimum_stability > 0 AND (stab IS NULL OR stab < minimum_stability) THEN 'below_evidence_threshold' END,
  CASE WHEN exclude_same_club AND team = club_id THEN 'same_club_excluded' END,
  CASE WHEN candidate_team_id IS NOT NULL AND team <> candidate_team_id THEN 'candidate_team_filter' END,
  CASE WHEN c.player_id = replacement_player_id THEN 'replacement_reference' END,
  CASE WHEN hx.player_id IS NOT NULL THEN 'hard_feature_constraint:carries_per90' END], lambda z: z IS NOT NULL)), ';') AS reasons
FROM sc s CROSS JOIN cd c LEFT JOIN hx ON hx.scenario_id = s.scenario_id AND hx.player_id = c.player_id""",
    "co",
)
def filter_reasons_full(v):
    """Every candidate of every role with all its reasons, those of other roles included."""
    s, r, c = inputs(v)
    out = J.judge(s, J.packed_requirements(r), c, ROLES)
    return out.select("scenario_id", "player_id", F.array_join("reasons", ";").alias("reasons"))


MODES = {f: (("near", "at_least", "at_most")[i % 3], float(1 + i % 2)) for i, f in enumerate(RATES)}


@query(
    "native_ranking_all",
    "J22",
    f"""WITH v AS ({" UNION ALL ".join(f"SELECT player_id, primary_role, competition_id, '{f}' AS feature, {f} AS value, '{m}' AS mode, {w}e0 AS weight FROM co" for f, (m, w) in MODES.items())}),
s AS (SELECT competition_id, feature, stddev_pop(value) AS scale FROM v GROUP BY ALL),
n AS (SELECT primary_role AS scenario_id, feature, quantile_cont(value, 0.5) AS target FROM v GROUP BY ALL),
g AS (SELECT n.scenario_id, v.player_id, v.competition_id, weight, mode, (value - target) / scale AS gap FROM v JOIN n ON n.scenario_id = v.primary_role AND n.feature = v.feature
  JOIN s ON s.feature = v.feature AND s.competition_id = v.competition_id)
SELECT scenario_id, player_id, competition_id AS league, round(sqrt(sum(weight * pow(CASE mode WHEN 'at_least' THEN greatest(0, -gap) WHEN 'at_most' THEN greatest(0, gap) ELSE abs(gap) END, 2)) / sum(weight)), 6) AS distance
FROM g GROUP BY ALL""",
    "co",
)
def native_ranking_all(v):
    """All eight raw values near, at least or at most the role's median, in league scales."""
    from turfline.operators.ordering import group_quantiles

    rows = settle(
        P.melt(v.co, ["player_id", "primary_role", "competition_id"], RATES).select(
            F.col("primary_role").alias("scenario_id"), "player_id", F.col("competition_id").alias("league"), "feature", "value"
        ),
        "native",
    )
    scales = rows.groupBy("league", "feature").agg(F.stddev_pop("value").alias("scale"))
    how = lambda i, kind: F.element_at(F.create_map(*[F.lit(x) for f, m in MODES.items() for x in (f, m[i])]), F.col("feature")).cast(kind)
    needs = group_quantiles(rows, ["scenario_id", "feature"], "value", {"target": 0.5})
    needs = needs.withColumns({"mode": how(0, "string"), "weight": how(1, "double")})
    return rounded(J.native_ranking(rows, needs, scales, ["scenario_id"]), "distance")
