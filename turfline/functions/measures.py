"""Column helpers: rates, guarded ratios, "unavailable is not zero" sums, reasons.

Every helper returns a Column, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def per90(value: str | Column, minutes: str | Column) -> Column:
    """Rate per 90 minutes; null without value or positive exposure."""
    value, minutes = col(value), col(minutes)
    return F.when(minutes > 0, value * 90.0 / minutes)


def guarded_ratio(num: str | Column, den: str | Column, scale: float = 1.0) -> Column:
    """scaled ratio; null on a null or non-positive denominator."""
    num, den = col(num), col(den)
    return F.when(den > 0, F.lit(float(scale)) * num / den)


def all_or_null_sum(value: str | Column) -> Column:
    """Sum that is null as soon as one row is null."""
    value = col(value)
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def poisoned_sum(value: str | Column, relevant: Column, unavailable: Column) -> Column:
    """Sum over relevant rows, 0 without any, null if one of them is unavailable."""
    value = col(value)
    bad = F.count_if(relevant & unavailable)
    return F.when(
        bad == 0, F.coalesce(F.sum(F.when(relevant, value.cast("double"))), F.lit(0.0))
    )


def count_where(condition: Column) -> Column:
    return F.count_if(condition).cast("double")


def reason_list(*pairs: tuple[Column, str]) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(label)) for cond, label in pairs]))


def sorted_reasons(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array(*arrays))))


def role_share_entropy(share: str | Column) -> Column:
    share = col(share)
    return -share * F.log(share)


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])


def mismatch(value: Column, target: Column, preference: Column) -> Column:
    """Directional loss of a value against a target."""
    delta = value - target
    return (
        F.when(preference == "neutral", F.lit(0.0))
        .when(preference == "minimum", F.greatest(F.lit(0.0), -delta))
        .when(preference == "maximum", F.greatest(F.lit(0.0), delta))
        .otherwise(F.abs(delta))
    )


def half_up(value: Column, decimals: int) -> Column:
    """floor(x*10^d + 1/2) / 10^d."""
    scale = float(10**decimals)
    return F.floor(value * scale + 0.5) / F.lit(scale)


def md5_int(*parts: str | Column) -> Column:
    """Deterministic 60-bit draw from key parts (bootstraps, perturbations)."""
    text = F.concat_ws(":", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def uniform_draw(low: float, high: float, *parts: str | Column) -> Column:
    """Hash-to-uniform draw in [low, high)."""
    return F.lit(low) + F.lit(high - low) * md5_int(*parts) / F.lit(float(2**60))


def digest_fold(key: Column, folds: int = 5, prefix: str = "") -> Column:
    """SHA-256 of the key as a big integer, modulo ``folds``.

    16^i mod m cycles, so the remainder is a weighted sum of the hex digits.
    """
    digest = F.sha2(F.concat(F.lit(prefix), key.cast("string")), 256)
    weights = [pow(16, 63 - i, folds) for i in range(64)]
    digits = F.transform(
        F.sequence(F.lit(1), F.lit(64)),
        lambda i: F.conv(F.substring(digest, i, F.lit(1)), 16, 10).cast("bigint"),
    )
    if set(weights) == {1}:
        total = F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: a + d)
    else:
        total = F.aggregate(
            F.zip_with(digits, F.array(*[F.lit(w) for w in weights]), lambda d, w: d * w),
            F.lit(0).cast("bigint"),
            lambda a, d: a + d,
        )
    return F.pmod(total, F.lit(folds)).cast("bigint")


def null_safe_in(value: Column, options: Iterable[str]) -> Column:
    return F.coalesce(value.isin(list(options)), F.lit(False))
