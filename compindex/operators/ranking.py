"""Ranks, movers, neighbours and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from compindex.operators import order as O


def rank_scored(df: DataFrame, score: str, ties: list[str], groups: list[str] | None = None, name: str = "rank"):
    """Rank 1 is the highest score; unscored rows are left out, ties keep input order."""
    scored = df.where(F.col(score).isNotNull())
    return O.ranked(scored, groups or [], [F.col(score).desc(), *[F.col(t) for t in ties]], name)


def rank_rounded(df: DataFrame, score: str, ties: list[str], digits: int = 4, groups: list[str] | None = None):
    """As ``rank_scored`` but on the rounded, published score."""
    shown = df.withColumn("_shown", F.round(score, digits))
    return rank_scored(shown, "_shown", ties, groups).drop("_shown")


def average_ranks(df: DataFrame, groups: list[str], value: str, name: str, descending: bool = False) -> DataFrame:
    """Average rank of tied values, ascending unless asked otherwise."""
    standing = O.with_standing(df, groups, value)
    up = O.average_rank(F.col("below"), F.col("n"))
    rank = (F.col("total") + 1) - up if descending else up
    return standing.withColumn(name, rank).drop("n", "below", "total")


def rank_shift(first: DataFrame, second: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """Places gained or lost between two rankings, over shared keys."""
    return first.select(key, F.col(rank).alias("rank_a")).join(second.select(key, F.col(rank).alias("rank_b")), key).withColumn(
        "shift", F.col("rank_a") - F.col("rank_b")
    )


def both_ends(df: DataFrame, order: list[Column], reverse: list[Column], k: int) -> DataFrame:
    """The ``k`` first and ``k`` last rows; each end is a bounded top-k."""
    head = df.orderBy(*order).limit(k).withColumn("side", F.lit("top"))
    tail = df.orderBy(*reverse).limit(k).withColumn("side", F.lit("bottom"))
    return head.unionByName(tail)


def top_by_group(df: DataFrame, groups: list[str], order: list[Column], k: int, name: str = "place") -> DataFrame:
    """First ``k`` rows per group; the limit is applied before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn(name, place).where(F.col(name) <= k)


def neighbours(ranked: DataFrame, key: str, carried: list[str], rank: str = "rank") -> DataFrame:
    """Keys ranked just above and just below, with the columns carried from them.

    Ranks are gap-free integers, so the neighbours are equi-joins instead of one ordered window.
    """
    above = ranked.select(
        (F.col(rank) + 1).alias(rank), F.col(key).alias("above"), *[F.col(c).alias(f"above_{c}") for c in carried]
    )
    below = ranked.select(
        (F.col(rank) - 1).alias(rank), F.col(key).alias("below"), *[F.col(c).alias(f"below_{c}") for c in carried]
    )
    return ranked.join(above, rank, "left").join(below, rank, "left")


def percentile_from_rank(rank: Column, n: Column) -> Column:
    """1 for the highest rank, 0 for the lowest."""
    return F.when(n > 1, 1.0 - F.try_divide((rank - 1).cast("double"), n - 1)).otherwise(F.lit(1.0))


def positional_numbers(crosswalk: DataFrame, phase: str, domain: str, pos: str) -> DataFrame:
    """phase.domain.signal numbers from design order (the design table is fixed and small)."""
    by_phase = Window.orderBy(phase)
    by_domain = Window.partitionBy(phase).orderBy(domain)
    by_signal = Window.partitionBy(phase, domain).orderBy(pos)
    return crosswalk.withColumn(
        "number",
        F.concat_ws(
            ".",
            F.dense_rank().over(by_phase).cast("string"),
            F.dense_rank().over(by_domain).cast("string"),
            F.row_number().over(by_signal).cast("string"),
        ),
    )


def key_set_report(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with membership flags; intersections and differences are filters on it."""
    a = first.select(*keys).distinct().withColumn("in_a", F.lit(True))
    b = second.select(*keys).distinct().withColumn("in_b", F.lit(True))
    joined = a.join(b, keys, "full_outer")
    return joined.select(*keys, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def jaccard(report: DataFrame, by: list[str] | None = None) -> DataFrame:
    both = F.count_if(F.col("in_a") & F.col("in_b"))
    either = F.count_if(F.col("in_a") | F.col("in_b"))
    return report.groupBy(*(by or [])).agg(
        both.alias("n_both"), F.count_if(F.col("in_a") & ~F.col("in_b")).alias("n_left"),
        F.count_if(F.col("in_b") & ~F.col("in_a")).alias("n_entered"),
        F.coalesce(F.try_divide(both.cast("double"), either), F.lit(0.0)).alias("jaccard"),
    )


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in a stated order."""
    return top_by_group(df, keys, order, 1, "_place").drop("_place")
