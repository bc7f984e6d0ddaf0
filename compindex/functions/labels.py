"""Classification expressions over scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tier cuts of the published scale.
TIER_CUTS = (0.281, 0.402)
# One-sided significance cuts of a z-score.
Z_CUTS = ((2.58, "99%"), (1.96, "95%"), (1.65, "90%"))


def corridor_role(outbound: Column, inbound: Column, strong: float = 0.5, weak: float = 0.4) -> Column:
    """Source, demand, dual or neither, where an absent side counts as weak."""
    out_strong = F.coalesce(outbound >= strong, F.lit(False))
    in_strong = F.coalesce(inbound >= strong, F.lit(False))
    out_weak = F.coalesce(outbound < weak, F.lit(True))
    in_weak = F.coalesce(inbound < weak, F.lit(True))
    both = F.coalesce((outbound >= weak) & (inbound >= weak), F.lit(False))
    return (
        F.when(out_strong & in_weak, "outbound-source")
        .when(in_strong & out_weak, "inbound-demand")
        .when(both, "dual")
        .otherwise("neither")
    )


def z_class(z: Column) -> Column:
    label = F.lit("ns")
    for cut, name in reversed(Z_CUTS):
        label = F.when(z >= cut, name).otherwise(label)
    return label


def tier(score: Column, cuts: tuple[float, float] = TIER_CUTS) -> Column:
    return (
        F.when(score >= cuts[1], "high").when(score >= cuts[0], "mid").when(score.isNotNull(), "low")
    )


def balance(first: Column, second: Column, gap: float = 0.06) -> Column:
    """Which of two halves carries the score; null unless both are known."""
    lean = second - first
    return F.when(lean > gap, "second").when(lean < -gap, "first").when(lean.isNotNull(), "balanced")


def lens_class(first: Column, second: Column, high: float = 0.66, low: float = 0.45, gap: float = 0.12) -> Column:
    """Reading of two lenses, also where only one of them is scored."""
    both = first.isNotNull() & second.isNotNull()
    return (
        F.when(both & (first >= high) & (second >= high), "both high")
        .when(both & (first - second > gap), "first stronger")
        .when(both & (second - first > gap), "second stronger")
        .when(both & (first < low) & (second < low), "neither")
        .when(both, "both moderate")
        .when(first.isNotNull(), F.when(first >= high, "first only, high").otherwise("first only"))
        .when(second.isNotNull(), "second only")
    )


def low_confidence(not_scored: Column, least: int = 2) -> Column:
    return F.coalesce(not_scored, F.lit(0)) >= least


def tercile(value: Column, lower: Column, upper: Column) -> Column:
    """High at or above the upper cut, low at or below the lower one."""
    return F.when(value >= upper, "high").when(value <= lower, "low").when(value.isNotNull(), "mid")


# The four quadrants of a local association.
def quadrant(own: Column, lag: Column) -> Column:
    return (
        F.when((own > 0) & (lag > 0), "High-High")
        .when((own <= 0) & (lag > 0), "Low-High")
        .when((own <= 0) & (lag <= 0), "Low-Low")
        .otherwise("High-Low")
    )
