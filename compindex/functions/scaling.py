"""Scaling expressions. Missing stays missing: no branch turns null into a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Clip to an interval. ``least``/``greatest`` skip nulls, hence the guard."""
    return F.when(value.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value)))


def anchored(value: Column, floor: Column, ceiling: Column, inverted: Column) -> Column:
    share = clamp((value - floor) / (ceiling - floor))
    return F.when(inverted, 1.0 - share).otherwise(share)


def complement(share: Column) -> Column:
    return 1.0 - share


def plus_optional(share: Column, extra: Column) -> Column:
    """Primary plus the secondary where it is known; null when the primary is null."""
    return share + F.coalesce(extra, F.lit(0.0))


def either_flag(known: Column, first_yes: Column, second_yes: Column) -> Column:
    """1 when any flag says yes, 0 for a known key without one, null for an unknown key."""
    hit = F.coalesce(first_yes, F.lit(False)) | F.coalesce(second_yes, F.lit(False))
    return F.when(known, F.when(hit, 1.0).otherwise(0.0))


def materiality_ramp(value: Column, cut: float = 0.20) -> Column:
    """Identity above the cut; quadratic damping below it."""
    return F.when(value >= cut, value).otherwise(value * value / F.lit(cut))


def hump(value: Column, enabled: bool, peak: float = 0.7, drop: float = 0.5) -> Column:
    """Score falling beyond a peak; identity while the switch is off."""
    if not enabled:
        return value
    fallen = F.lit(peak) - (value - peak) / F.lit(1.0 - peak) * F.lit(drop * peak)
    return F.when(value <= peak, value).otherwise(fallen)


def severity_weight(value: Column) -> Column:
    return 1.0 + F.log10(1.0 + F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)))


def log_index(count: Column, largest: Column) -> Column:
    return F.log1p(count.cast("double")) / F.log1p(largest.cast("double"))


def blend(first: Column, second: Column) -> Column:
    """Mean of two readings, or the only one there is."""
    return F.coalesce((first + second) / F.lit(2.0), first, second)


def weighted_pair(first: Column, second: Column, w_first, w_second) -> Column:
    w1 = w_first if isinstance(w_first, Column) else F.lit(float(w_first))
    w2 = w_second if isinstance(w_second, Column) else F.lit(float(w_second))
    return w1 * first + w2 * second


def present_count(values: list[Column]) -> Column:
    total = F.lit(0)
    for value in values:
        total = total + value.isNotNull().cast("int")
    return total


def present_mean(values: list[Column]) -> Column:
    """Row-wise mean over the non-null inputs; null when there is none."""
    total = F.lit(0.0)
    for value in values:
        total = total + F.coalesce(value, F.lit(0.0))
    count = present_count(values)
    return F.when(count > 0, total / count)


def meets_floor(n: Column, total: Column, share: float = 0.5, least: int = 2) -> Column:
    """At least ``least`` inputs and at least ``share`` of them present."""
    return (n >= least) & (n >= F.greatest(F.lit(float(least)), F.lit(share) * total))


def below_coverage(n: Column, total: Column, share: float = 0.5, least: int = 2) -> Column:
    return (total > 0) & ((F.try_divide(n, total) < share) | (n < least))


def coverage_percent(n: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(100.0) * n, total), F.lit(0.0))
