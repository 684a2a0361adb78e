"""Season-to-season rate prediction with empirical intervals.

Episodes: player_id, source/destination minutes, counts, roles and teams,
role_change, contexts. Rates are counts per 90 minutes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfline.functions.measures import digest_fold, per90, reason_list
from turfline.operators.ordering import value_ladder
from turfline.operators.timesplit import role_change

COVERAGES = {50: 0.50, 80: 0.80, 95: 0.95}


def with_rates(episodes: DataFrame, target: str) -> DataFrame:
    """Observed source and destination rates of a target count."""
    return episodes.withColumns(
        {
            "source_rate": per90(f"source_{target}", "source_minutes"),
            "actual": per90(f"destination_{target}", "destination_minutes"),
            "_count": F.col(f"destination_{target}"),
            "_exposure": F.col("destination_minutes") / 90,
        }
    )


def role_means(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K4: exposure-weighted mean per destination role, and overall (one row)."""
    rate = F.sum("_count") / F.sum("_exposure")
    return (
        train.groupBy("destination_role").agg(rate.alias("role_mean")),
        train.agg(rate.alias("mean")),
    )


def predict_role_mean(rows: DataFrame, train: DataFrame) -> DataFrame:
    """K4: role mean with the population mean for roles not seen in training."""
    by_role, overall = role_means(train)
    return (
        rows.join(by_role, "destination_role", "left")
        .join(F.broadcast(overall))
        .withColumn("point", F.coalesce("role_mean", "mean"))
        .drop("role_mean", "mean")
    )


def predict_unchanged(rows: DataFrame) -> DataFrame:
    """K4: the source rate carried over."""
    return rows.withColumn("point", F.col("source_rate"))


def role_mean_residuals(train: DataFrame, folds: int = 5) -> DataFrame:
    """K6: player-separated residuals of the role mean. A fold's training totals
    are the totals minus its own, so nothing is refitted."""
    rows = train.withColumn("fold", digest_fold(F.col("player_id"), folds))
    sums = [F.sum("_count").alias("c"), F.sum("_exposure").alias("e")]
    by_role_fold = rows.groupBy("destination_role", "fold").agg(*sums)
    both = Window.partitionBy("destination_role")  # one row per fold
    left = by_role_fold.select(
        "destination_role",
        "fold",
        (F.sum("c").over(both) - F.col("c")).alias("rc"),
        (F.sum("e").over(both) - F.col("e")).alias("re"),
    )
    by_fold = by_role_fold.groupBy("fold").agg(F.sum("c").alias("c"), F.sum("e").alias("e"))
    everything = by_fold.agg(F.sum("c").alias("tc"), F.sum("e").alias("te"))
    overall = by_fold.join(F.broadcast(everything)).select(
        "fold", ((F.col("tc") - F.col("c")) / (F.col("te") - F.col("e"))).alias("mean")
    )
    point = F.coalesce(F.when(F.col("re") > 0, F.col("rc") / F.col("re")), F.col("mean"))
    fitted = rows.join(left, ["destination_role", "fold"]).join(overall, "fold")
    return centred(fitted.where(F.col("mean").isNotNull()).select((F.col("actual") - point).alias("residual")))


def unchanged_residuals(train: DataFrame) -> DataFrame:
    return centred(train.select((F.col("actual") - F.col("source_rate")).alias("residual")))


def centred(residuals: DataFrame) -> DataFrame:
    """K6: residuals minus their mean (one broadcast row)."""
    mean = residuals.agg(F.avg("residual").alias("_mean"))
    return residuals.join(F.broadcast(mean)).select((F.col("residual") - F.col("_mean")).alias("residual"))


def residual_spots(residuals: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Order statistics around each quantile of the residuals: one row.

    Clipping at zero is monotone, so a quantile of max(0, point + residual) only
    needs the two neighbouring residuals -- no row ever meets all residuals.
    """
    ladder = value_ladder(residuals, [], "residual")
    below, at, total = F.col("n_below"), F.col("n"), F.col("n_total")
    parts = []
    for i, p in enumerate(probs):
        spot = (total - 1) * F.lit(float(p))
        pick = lambda place: F.max(
            F.when((below <= place) & (place < below + at), F.col("residual"))
        )
        parts += [
            pick(F.floor(spot)).alias(f"_lo{i}"),
            pick(F.ceil(spot)).alias(f"_hi{i}"),
            F.max(spot - F.floor(spot)).alias(f"_f{i}"),
        ]
    return ladder.agg(*parts)


def with_quantiles(rows: DataFrame, residuals: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Predictive quantiles of every row, named by ``probs``."""
    joined = rows.join(F.broadcast(residual_spots(residuals, list(probs.values()))))
    zero = lambda c: F.greatest(F.lit(0.0), F.col("point") + F.col(c))
    made = {
        name: zero(f"_lo{i}") + (zero(f"_hi{i}") - zero(f"_lo{i}")) * F.col(f"_f{i}")
        for i, name in enumerate(probs)
    }
    return joined.select(*rows.columns, *[c.alias(n) for n, c in made.items()])


def interval_probs() -> dict[str, float]:
    out = {}
    for name, c in COVERAGES.items():
        out[f"lo{name}"], out[f"hi{name}"] = (1 - c) / 2, 1 - (1 - c) / 2
    return out


def interval_metrics(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """K7: MAE, RMSE and per coverage the hit rate, mean width and interval score."""
    gap = F.col("actual") - F.col("point")
    parts = [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
    ]
    for name, c in COVERAGES.items():
        lo, hi, y = F.col(f"lo{name}"), F.col(f"hi{name}"), F.col("actual")
        penalty = F.greatest(lo - y, F.lit(0.0)) + F.greatest(y - hi, F.lit(0.0))
        parts += [
            F.avg(y.between(lo, hi).cast("double")).alias(f"coverage{name}"),
            F.avg(hi - lo).alias(f"width{name}"),
            F.avg(hi - lo + 2 / (1 - c) * penalty).alias(f"score{name}"),
        ]
    return rows.groupBy(*keys).agg(*parts)


def choose_method(metrics: DataFrame, preferred: str) -> DataFrame:
    """K8: keep the preferred method unless a gate fails against the best baseline."""
    is_own = F.col("method") == preferred
    best = metrics.where(~is_own).agg(
        F.min_by(
            F.struct("method", "mae", "width80"), F.struct("mae", "method")
        ).alias("best")
    )
    own = metrics.where(is_own).join(F.broadcast(best))
    reasons = reason_list(
        (F.col("mae") > 1.10 * F.col("best.mae"), "validation_point_error"),
        (~F.col("coverage80").between(0.65, 0.95), "validation_coverage"),
        (F.col("width80") > 1.5 * F.col("best.width80"), "validation_width"),
    )
    return own.select(
        F.when(F.size(reasons) > 0, F.col("best.method")).otherwise(F.lit(preferred)).alias("method"),
        reasons.alias("reasons"),
    )


def subgroups(rows: DataFrame, seen: DataFrame, bounds: DataFrame) -> DataFrame:
    """K9: tag evaluation rows with every subgroup they belong to.

    seen: training players; bounds: one row with d10 and d90 of the outcome.
    """
    known = rows.join(seen.select("player_id", F.lit(True).alias("_seen")).distinct(), "player_id", "left")
    moved = F.col("source_team_id") != F.col("destination_team_id")
    tags = reason_list(
        (F.lit(True), "all"),
        (~moved, "same_team"),
        (moved, "changed_team"),
        (F.col("_seen").isNull(), "unseen_player"),
        (F.col("actual") <= F.col("d10"), "bottom_decile"),
        (F.col("actual") >= F.col("d90"), "top_decile"),
    )
    return known.join(F.broadcast(bounds)).withColumn("subgroup", F.explode(tags)).drop("_seen", "d10", "d90")


# -- regressions -----------------------------------------------------------------------


def design_columns(rows: DataFrame, numeric: Sequence[str], roles: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Numeric covariates plus one-hot source and destination roles."""
    made = {}
    for side in ("source", "destination"):
        for i, r in enumerate(roles):
            made[f"_{side}_{i}"] = (F.col(f"{side}_role") == r).cast("double")
    return rows.withColumns(made), [*numeric, *made]


def fit_ridge(train: DataFrame, columns: Sequence[str], label: str, alpha: float = 10.0):
    """K5: ridge on standardised covariates; returns a row -> prediction function."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    assembler = VectorAssembler(inputCols=list(columns), outputCol="raw", handleInvalid="error")
    raw = assembler.transform(train.select(*columns, F.col(label).alias("label")))
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(raw)
    n, spread = raw.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
    # The library scales columns by the sample deviation; the factor restores the
    # population one the penalty is defined on.
    factor = (n - 1) / n
    model = LinearRegression(
        solver="normal", standardization=False, elasticNetParam=0.0,
        regParam=alpha / n * spread * factor, maxIter=1,
    ).fit(scaler.transform(raw))

    def predict(rows: DataFrame) -> DataFrame:
        scored = model.transform(scaler.transform(assembler.transform(rows)))
        return scored.withColumn("point", F.greatest(F.lit(0.0), F.col("prediction"))).drop(
            "raw", "features", "prediction"
        )

    return predict


def ridge_residuals(train: DataFrame, columns: Sequence[str], label: str, folds: int = 5) -> DataFrame:
    """K6: player-separated residuals of the ridge, one fit per fold."""
    rows = train.withColumn("fold", digest_fold(F.col("player_id"), folds))
    parts = None
    for fold in range(folds):
        predict = fit_ridge(rows.where(F.col("fold") != fold), columns, label)
        part = predict(rows.where(F.col("fold") == fold)).select(
            (F.col(label) - F.col("point")).alias("residual")
        )
        parts = part if parts is None else parts.unionByName(part)
    return centred(parts)


def fit_poisson(train: DataFrame, columns: Sequence[str], count: str, exposure: str):
    """Log-rate model of counts with an exposure offset."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    prepare = lambda d: assembler.transform(d.withColumn("_offset", F.log(exposure)))
    model = GeneralizedLinearRegression(
        family="poisson", link="log", offsetCol="_offset", labelCol=count, featuresCol="features",
        regParam=0.01, maxIter=50, predictionCol="expected",
    ).fit(prepare(train))

    def predict(rows: DataFrame) -> DataFrame:
        return model.transform(prepare(rows)).drop("features", "_offset")

    return predict


# -- support, grid and reports ---------------------------------------------------------


def development_bounds(episodes: DataFrame, target: str) -> DataFrame:
    """Range of source rates seen in development (one row)."""
    rate = per90(f"source_{target}", "source_minutes")
    return episodes.agg(F.min(rate).alias("low"), F.max(rate).alias("high"))


def source_support(
    environments: DataFrame, bounds: DataFrame, target: str, season: int, roles: Sequence[str],
    minimum: float = 600,
) -> DataFrame:
    """Why an environment cannot serve as a source."""
    rate = per90(target, "minutes")
    reasons = F.array_sort(
        reason_list(
            (F.col("season") != season, "outside_source_season"),
            (F.col("quarantined"), "identity_quarantined"),
            (F.col("minutes") < minimum, f"below_{int(minimum)}_reliable_minutes"),
            (~F.coalesce(F.col("role").isin(list(roles)), F.lit(False)), "unsupported_source_role"),
            (rate.isNull(), "missing_source_features"),
            (~rate.between(F.col("low"), F.col("high")), "source_outside_development_range"),
        )
    )
    return environments.join(F.broadcast(bounds)).withColumn("exclusions", reasons).drop("low", "high")


def scenario_grid(
    sources: DataFrame, targets: DataFrame, development: DataFrame, on: Sequence[str], roles: Sequence[str],
    minimum_role_episodes: int = 5,
) -> DataFrame:
    """Every source stint x target team of its scope x role, with status, evidence
    counts and reasons. Sources and targets meet on their scope; evidence comes as
    grouped counts. ``context_ready`` flags say whether both contexts exist."""
    grid = sources.join(targets, list(on)).withColumn(
        "target_role", F.explode(F.array(*[F.lit(r) for r in roles]))
    )
    count = F.count(F.lit(1))
    direct = development.groupBy(
        "source_team_id",
        F.col("destination_team_id").alias("target_team_id"),
        F.col("destination_role").alias("target_role"),
    ).agg(count.alias("direct_episodes"), F.size(F.collect_set("player_id")).alias("direct_players"))
    team_role = development.groupBy(
        F.col("destination_team_id").alias("target_team_id"),
        F.col("destination_role").alias("target_role"),
    ).agg(count.alias("team_role_episodes"))
    by_role = development.groupBy(F.col("destination_role").alias("target_role")).agg(
        count.alias("role_episodes")
    )
    filled = (
        grid.join(direct, ["source_team_id", "target_team_id", "target_role"], "left")
        .join(team_role, ["target_team_id", "target_role"], "left")
        .join(by_role, "target_role", "left")
        .fillna(0, ["direct_episodes", "direct_players", "team_role_episodes", "role_episodes"])
        .withColumn("role_change", role_change(F.col("source_role"), F.col("target_role")))
    )
    near = F.col("role_change").isin("same", "adjacent")
    reasons = reason_list(
        (~near, "unsupported_role_change"),
        (F.col("role_episodes") < minimum_role_episodes, f"fewer_than_{minimum_role_episodes}_role_episodes"),
        (~F.col("source_context") | ~F.col("target_context"), "missing_prechange_team_context"),
    )
    return filled.withColumns(
        {
            "exclusions": reasons,
            "status": F.when(~near, "out_of_scope")
            .when(F.size(reasons) > 0, "insufficient_evidence")
            .otherwise("supported"),
            "relies_on_pooling": F.col("direct_episodes") < 5,
        }
    )


def estimates(rows: DataFrame, residuals: DataFrame) -> DataFrame:
    """Point and 2.5 / 10 / 90 / 97.5 % values, rounded to five places."""
    probs = {"p025": 0.025, "p10": 0.1, "p90": 0.9, "p975": 0.975}
    out = with_quantiles(rows, residuals, probs)
    return out.withColumns({c: F.round(c, 5) for c in ["point", *probs]})


def change_description(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Destination minus source: mean, median, sample deviation, p10, p90."""
    from turfline.operators.ordering import quantile_columns

    change = rows.withColumn("change", F.col("actual") - F.col("source_rate"))
    spread = value_ladder(change, keys, "change").groupBy(*keys).agg(
        *quantile_columns({"median": 0.5, "p10": 0.1, "p90": 0.9}, "change")
    )
    moments = change.groupBy(*keys).agg(
        F.count("change").alias("n"), F.avg("change").alias("mean"), F.stddev_samp("change").alias("sd")
    )
    return moments.join(spread, list(keys))


def holdout_table(predictions: dict[str, DataFrame], ident: Sequence[str]) -> DataFrame:
    """One row per episode with every method's point side by side."""
    parts = None
    for name, df in predictions.items():
        part = df.select(*ident, "actual", F.lit(name).alias("method"), "point")
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(*ident, "actual").pivot("method", list(predictions)).agg(F.first("point"))


def identity_status(records: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """K1: conflicting metadata inside one provider identity, never across names.

    ``name`` is compared after normalisation, attributes ignoring nulls."""
    from turfline.functions.text import normalise_name

    named = records.withColumn("_name", normalise_name("name"))
    differ = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    reasons = reason_list(
        (differ("_name"), "conflicting_names"),
        *[(differ(a), f"conflicting_{a}") for a in attributes],
    )
    out = named.groupBy(*keys).agg(reasons.alias("reasons"), F.count(F.lit(1)).alias("records"))
    return out.withColumn(
        "status",
        F.when(F.size("reasons") > 0, "quarantined").otherwise("provider_id_consistent_metadata"),
    )


def identity_catalogue(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K2/K3: distinct teams, seasons and competitions of each identity, from merged rows."""
    merged = rows.groupBy(*keys, "team_id", "season", "competition_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    return merged.groupBy(*keys).agg(
        F.size(F.collect_set("team_id")).alias("teams"),
        F.size(F.collect_set("season")).alias("seasons"),
        F.size(F.collect_set("competition_id")).alias("competitions"),
        F.sum("n").alias("appearances"),
    )


def roster_members(matches: DataFrame) -> DataFrame:
    """K3: players of nested match rosters (line-up, bench, substitutions)."""
    team = matches.select(
        "match_id", "competition_id", "season", F.explode("teams").alias("team_id", "sheet")
    )
    sub = F.flatten(F.transform("sheet.substitutions", lambda s: F.array(s["enters"], s["leaves"])))
    everyone = F.array_distinct(
        F.concat(
            F.coalesce("sheet.lineup", F.array()),
            F.coalesce("sheet.bench", F.array()),
            F.coalesce(sub, F.array()),
        )
    )
    return team.select(
        "match_id", "competition_id", "season", "team_id", F.explode(everyone).alias("player_id")
    )
