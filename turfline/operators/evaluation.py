"""Retrieval metrics, resampling and distribution tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline.functions.measures import digest_fold, md5_int, reason_list
from turfline.operators.ordering import average_rank, quantile_columns, row_index, value_ladder
from turfline.operators.profiles import melt
from turfline.session import settle

EULER = 0.5772156649015329


def harmonic(n: Column) -> Column:
    """H(n) by one formula: the expansion at n + 16, less the sixteen terms in between."""
    x = n.cast("double") + 16
    square = x * x
    series = F.log(x) + EULER + 1 / (2 * x) - (1 / 12 - (1 / 120 - (1 / 252 - 1 / (240 * square)) / square) / square) / square
    return series - sum((1 / (n.cast("double") + i) for i in range(1, 17)), F.lit(0.0))


def retrieval_metrics(ranks: DataFrame, keys: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """Queries, recall at 1/5/10 and mean reciprocal rank."""
    hit = lambda k: F.avg((F.col(rank) <= k).cast("double"))
    return ranks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("queries"),
        hit(1).alias("recall1"),
        hit(5).alias("recall5"),
        hit(10).alias("recall10"),
        F.avg(1.0 / F.col(rank)).alias("mrr"),
    )


def random_expectation(ranks: DataFrame, keys: Sequence[str] = (), size: str = "candidates") -> DataFrame:
    """Expected metrics of a random order; one row per pool size is evaluated."""
    pools = ranks.groupBy(*keys, size).agg(F.count(F.lit(1)).alias("_q"))
    n, q = F.col(size), F.col("_q")
    at = lambda k: (F.sum(q * F.least(F.lit(k), n) / n) / F.sum(q)).alias(f"random_recall{k}")
    return pools.groupBy(*keys).agg(
        at(1), at(5), at(10), (F.sum(q * harmonic(n) / n) / F.sum(q)).alias("random_mrr")
    )


def tie_aware(ranks: DataFrame) -> DataFrame:
    """I4: reciprocal rank and recall averaged over the tie block of the counterpart."""
    earlier, tied = F.col("earlier"), F.col("tied")
    rr = (harmonic(earlier + tied) - harmonic(earlier)) / tied
    recall = lambda k: F.least(F.greatest(F.lit(k) - earlier, F.lit(0)), tied) / tied
    return ranks.withColumns({"rr": rr, "tie_recall5": recall(5), "tie_recall10": recall(10)})


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two id arrays; two empty ones overlap fully."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def resample(
    rows: DataFrame, keys: Sequence[str], order: str, ident: str, draws: int, seed: str
) -> DataFrame:
    """Whole-row bootstrap; every draw of a key picks as many rows as it has.

    Picks are a hash of (seed, draw, key, slot), the lookup is an equi-join on
    (key, place), so a key with many rows spreads over all tasks. Picked twice is
    stored once with a multiplicity.
    """
    # Read three times below, so the numbering is written once.
    numbered = settle(row_index(rows, keys, order, ident, "_place"), "numbered")
    sizes = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    slots = numbered.select(*keys, F.col("_place").alias("_slot")).join(sizes, list(keys))
    picks = (
        slots.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
        .withColumn("_place", md5_int(F.lit(seed), "draw", *keys, "_slot") % F.col("_size") + 1)
        .groupBy(*keys, "draw", "_place")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    return picks.join(numbered, [*keys, "_place"]).drop("_place")


def bootstrap_rates(
    rows: DataFrame, keys: Sequence[str], order: str, ident: str, counts: Sequence[str], draws: int,
    seed: str, context: dict[str, str] | None = None,
) -> DataFrame:
    """Rates per 90 (and context rates per 100) of every draw and key."""
    picked = resample(rows, keys, order, ident, draws, seed)
    minutes = F.sum(F.col("minutes") * F.col("times"))
    total = lambda c: F.sum(F.col(c) * F.col("times"))
    extra = [
        (100 * total(c) / total(d)).alias(f"{c}_per100") for c, d in (context or {}).items()
    ]
    return picked.groupBy(*keys, "draw").agg(
        *[(90 * total(c) / minutes).alias(f"{c}_per90") for c in counts], *extra
    )


def bootstrap_mean(
    rows: DataFrame, keys: Sequence[str], value: str, ident: str, draws: int, seed: str
) -> DataFrame:
    """95 % interval of a mean; the quantiles run over at most ``draws`` means."""
    picked = resample(rows, keys, value, ident, draws, seed)
    means = picked.groupBy(*keys, "draw").agg(
        (F.sum(F.col(value) * F.col("times")) / F.sum("times")).alias("m")
    )
    bounds = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*keys).agg(bounds.alias("b")).select(
        *keys, F.col("b")[0].alias("low"), F.col("b")[1].alias("high")
    )


def neighbour_sets(neighbours: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Neighbour ids of a key as one array (at most k of them)."""
    return neighbours.groupBy(*keys).agg(F.collect_set("neighbour").alias("ids"))


def overlap(baseline: DataFrame, other: DataFrame, keys: Sequence[str], extra: Sequence[str]) -> DataFrame:
    """Jaccard of each row's neighbours with the baseline's."""
    a = neighbour_sets(baseline, keys).withColumnRenamed("ids", "base")
    b = neighbour_sets(other, [*keys, *extra])
    return b.join(a, list(keys)).withColumn("jaccard", jaccard(F.col("base"), F.col("ids")))


def list_overlap(baseline: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``overlap`` where the neighbours of a row come as one array ``ids``; empty ones are left out."""
    a = baseline.where(F.size("ids") > 0).withColumnRenamed("ids", "base")
    return other.where(F.size("ids") > 0).join(a, list(keys)).withColumn("jaccard", jaccard(F.col("base"), F.col("ids")))


def bootstrap_stability(
    baseline: DataFrame, drawn: DataFrame, keys: Sequence[str], draws: int
) -> tuple[DataFrame, DataFrame]:
    """(mean overlap per row, inclusion frequency per baseline neighbour)."""
    overlaps = overlap(baseline, drawn, keys, ["draw"])
    per_row = overlaps.groupBy(*keys).agg(F.avg("jaccard").alias("stability"))
    seen = drawn.groupBy(*keys, "neighbour").agg((F.count(F.lit(1)) / draws).alias("inclusion"))
    inclusion = baseline.select(*keys, "neighbour").join(seen, [*keys, "neighbour"], "left")
    return per_row, inclusion.withColumn("inclusion", F.coalesce("inclusion", F.lit(0.0)))


def spearman(df: DataFrame, keys: Sequence[str], ident: Sequence[str], a: str, b: str) -> DataFrame:
    """Correlation of average ranks per group; both sides ranked via ladders."""
    def ranked(value: str, out: str) -> DataFrame:
        ladder = value_ladder(df, keys, value)
        return ladder.select(*keys, value, average_rank().alias(out))

    joined = (
        df.select(*keys, a, b)
        .join(ranked(a, "_ra"), [*keys, a])
        .join(ranked(b, "_rb"), [*keys, b])
    )
    # A side without variation has no correlation; ``corr`` would divide by zero there.
    spread = F.stddev_pop("_ra") * F.stddev_pop("_rb")
    return joined.groupBy(*keys).agg(F.try_divide(F.covar_pop("_ra", "_rb"), spread).alias("spearman"))


def feature_stability(first: DataFrame, second: DataFrame, group: Sequence[str], ident: str,
                      features: Sequence[str]) -> DataFrame:
    """Spearman of every feature between two halves."""
    a = melt(first, [*group, ident], features).withColumnRenamed("value", "a")
    b = melt(second, [*group, ident], features).withColumnRenamed("value", "b")
    pairs = a.join(b, [*group, ident, "feature"])
    return spearman(pairs, [*group, "feature"], [ident], "a", "b")


def two_group_distance(
    df: DataFrame, keys: Sequence[str], side: Column, value: str
) -> DataFrame:
    """Per group the two sides' sizes, moments, quantiles, Kolmogorov-Smirnov
    and Wasserstein-1 distances, from one ordered pass over distinct values."""
    flagged = df.withColumn("_side", side)
    ladder = value_ladder(
        flagged,
        keys,
        value,
        {"a": F.col("_side").cast("int"), "b": (~F.col("_side")).cast("int")},
    )
    upto = lambda s: (F.col(f"{s}_below") + F.col(s)) / F.col(f"{s}_total")
    gap = F.abs(upto("a") - upto("b"))
    width = F.col("next_value") - F.col(value)
    probs = {"median": 0.5, "q10": 0.1, "q90": 0.9}
    sides = []
    for s in ("a", "b"):
        sides += [
            F.max(f"{s}_total").alias(f"n_{s}"),
            (F.sum(F.col(value) * F.col(s)) / F.max(f"{s}_total")).alias(f"mean_{s}"),
            *quantile_columns({f"{n}_{s}": p for n, p in probs.items()}, value, s),
        ]
    return ladder.where((F.col("a_total") > 0) & (F.col("b_total") > 0)).groupBy(*keys).agg(
        F.max(gap).alias("ks"),
        F.coalesce(F.sum(gap * width), F.lit(0.0)).alias("wasserstein"),
        *sides,
    )


def group_balance(neighbours: DataFrame, sides: DataFrame, ident: str, pool: Sequence[str], side: str) -> DataFrame:
    """Share of neighbours on the own side against the share available."""
    mine = sides.select(ident, *pool, F.col(side).alias("_own"))
    theirs = sides.select(F.col(ident).alias("neighbour"), F.col(side).alias("_other"))
    same = (F.col("_own") == F.col("_other")).cast("double")
    seen = neighbours.select(ident, "neighbour").join(mine, ident).join(theirs, "neighbour")
    observed = seen.groupBy(*pool).agg(F.avg(same).alias("neighbour_share"))
    sizes = sides.groupBy(*pool, side).agg(F.count(F.lit(1)).alias("_n"))
    available = sizes.groupBy(*pool).agg(F.sum("_n").alias("_t"), F.sum(F.col("_n") * (F.col("_n") - 1)).alias("_p"))
    expected = F.when(F.col("_t") > 1, F.col("_p") / (F.col("_t") * (F.col("_t") - 1)))
    return observed.join(available, list(pool)).select(
        *pool, "neighbour_share", expected.alias("available_share")
    )


def select_threshold(results: DataFrame, share: float = 0.9, development: Sequence | None = None) -> DataFrame:
    """Smallest threshold reaching ``share`` of the best macro score.

    results: threshold, provider, queries, mrr -- one row per scope, with ``scope`` where
    ``development`` names the scopes that count. Both providers must have evidence; if no
    threshold has, the row that is asked for raises an error."""
    if development is not None:
        results = results.where(F.col("scope").isin(*development))
    provider = results.groupBy("threshold", "provider").agg(
        (F.sum(F.col("mrr") * F.col("queries")) / F.sum("queries")).alias("score")
    )
    macro = provider.groupBy("threshold").agg(
        F.avg("score").alias("score"), F.count(F.lit(1)).alias("sides")
    )
    macro = macro.where(F.col("sides") == 2)
    best = macro.agg(F.max("score").alias("best"))  # one row
    reached = F.col("score") + 1e-12 >= share * F.col("best")
    passed = macro.join(F.broadcast(best)).where(reached).agg(F.min("threshold").alias("threshold"))
    short = F.raise_error(F.lit("no threshold has development evidence of both providers")).cast("int")
    return passed.select(F.coalesce("threshold", short).alias("threshold"))


def role_gate(
    metrics: DataFrame, keys: Sequence[str], minimum_pairs: int = 20, floor: float = 0.35,
    multiple: float = 1.5,
) -> DataFrame:
    """pass/fail of each role with reasons, from joined metric columns."""
    reasons = reason_list(
        (F.col("queries") < minimum_pairs, "fewer_than_registered_role_pairs"),
        (
            F.coalesce(F.col("median_spearman") < floor, F.lit(True)),
            "profile_stability_below_registered_floor",
        ),
        (
            F.col("recall5") < multiple * F.col("random_recall5"),
            "recall5_below_registered_random_multiple",
        ),
        (F.col("mrr") < multiple * F.col("random_mrr"), "mrr_below_registered_random_multiple"),
    )
    return metrics.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def first_passing_threshold(gates: DataFrame, scope: Sequence[str], minimum_roles: int = 2) -> DataFrame:
    """First threshold with enough passing roles and the roles it enables."""
    per = gates.groupBy(*scope, "threshold").agg(
        F.count_if("passed").alias("passing"),
        F.array_sort(F.collect_set(F.when(F.col("passed"), F.col("primary_role")))).alias("roles"),
    )
    chosen = per.groupBy(*scope).agg(
        F.min(F.when(F.col("passing") >= minimum_roles, F.col("threshold"))).alias("threshold")
    )
    return chosen.join(per, [*scope, "threshold"], "left").select(
        *scope, "threshold", F.coalesce("roles", F.array().cast("array<string>")).alias("roles")
    )


def detectability(
    rows: DataFrame, label: str, strata: Sequence[str], ident: str, features: Sequence[str], draws: int = 500
) -> DataFrame:
    """Can a balanced logistic model tell the two groups apart?

    Strata keep as many rows of each group as the smaller one has (by hash
    order), identities are held out by hash (30 %), scaling is fitted on the
    training part, classes are weighted, C = 1. Returns AUC, balanced accuracy and
    an identity-bootstrap interval of the accuracy.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    keyed = rows.select(ident, *strata, F.col(label).cast("int").alias("label"), *features).withColumn(
        "_h", md5_int(F.lit("match"), ident)
    )
    sizes = keyed.groupBy(*strata, "label").agg(F.count(F.lit(1)).alias("n")).groupBy(*strata).agg(
        F.min("n").alias("_keep"), F.count(F.lit(1)).alias("_sides")
    )
    ordered = row_index(keyed, [*strata, "label"], "_h", ident, "_r")
    matched = ordered.join(sizes.where(F.col("_sides") == 2), list(strata)).where(
        F.col("_r") <= F.col("_keep")
    )
    held = digest_fold(F.col(ident), 10, "holdout:") < 3
    data = VectorAssembler(inputCols=list(features), outputCol="raw").transform(
        matched.withColumn("held", held)
    )
    data = settle(data.select(ident, "label", "held", "raw"), "matched")
    train, test = data.where(~F.col("held")), data.where("held")
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    n = sum(counts.values())
    weight = F.when(F.col("label") == 1, n / (2.0 * counts.get(1, 1))).otherwise(n / (2.0 * counts.get(0, 1)))
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    model = LogisticRegression(
        weightCol="w", regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False
    ).fit(scaler.transform(train).withColumn("w", weight))
    scored = model.transform(scaler.transform(test))
    auc = BinaryClassificationEvaluator().evaluate(scored)
    judged = scored.select(
        F.col(ident).alias("ident"),
        "label",
        (F.when(vector_to_array("probability")[1] >= 0.5, 1).otherwise(0) == F.col("label"))
        .cast("double")
        .alias("hit"),
    )
    judged = settle(judged, "judged")
    balanced = judged.agg(
        ((F.avg(F.when(F.col("label") == 1, F.col("hit"))) + F.avg(F.when(F.col("label") == 0, F.col("hit")))) / 2).alias("balanced_accuracy"),
        F.count(F.lit(1)).alias("held_out"),
    ).withColumn("g", F.lit(0))
    interval = bootstrap_mean(judged.withColumn("g", F.lit(0)), ["g"], "hit", "ident", draws, "detect")
    return balanced.join(interval, "g").select(
        F.lit(float(auc)).alias("auc"), "balanced_accuracy", "held_out",
        F.col("low").alias("accuracy_low"), F.col("high").alias("accuracy_high"),
    )
