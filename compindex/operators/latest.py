"""One observation per (key, series): recency, preferred waves, windows and exposures.

Picks are ``max`` over an ordering struct, which combines on the map side: a key that holds
a third of all rows shrinks to one row per task before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick_first(df: DataFrame, keys: list[str], priority: list[Column], columns: list[str]) -> DataFrame:
    """The row with the largest ``priority`` per key; priorities must make it unique."""
    ordering = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(priority)])
    payload = F.struct(*[F.col(c) for c in columns])
    best = df.groupBy(*keys).agg(F.max(F.struct(ordering.alias("o"), payload.alias("v"))).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.v.{c}").alias(c) for c in columns])


def latest_value(
    df: DataFrame,
    keys: list[str],
    time: str = "year",
    seq: str = "seq",
    value: str = "value",
    last_wins: bool = False,
    preferred=None,
) -> DataFrame:
    """Most recent non-null observation.

    A tie in time goes to the first-read row, or to the last-read one with ``last_wins``.
    With ``preferred``, that wave beats any other, however recent.
    """
    usable = df.where(F.col(value).isNotNull() & F.col(time).isNotNull())
    priority = [F.col(time), F.col(seq) if last_wins else -F.col(seq)]
    if preferred is not None:
        priority.insert(0, F.col(time) == F.lit(preferred))
    return pick_first(usable, keys, priority, [time, seq, value])


def winner_span(winners: DataFrame, by: list[str], time: str = "year") -> DataFrame:
    """Count and first/last year of the chosen observations."""
    return winners.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("year_min"), F.max(time).alias("year_max")
    )


def stale_count(winners: DataFrame, by: list[str], preferred, time: str = "year") -> DataFrame:
    return winners.groupBy(*by).agg(
        F.count_if(F.col(time) != F.lit(preferred)).alias("n_stale"), F.count(F.lit(1)).alias("n")
    )


def latest_stock(df: DataFrame, keys: list[str], time: str = "year", seq: str = "seq", value: str = "value"):
    """Latest value beside the span of every scanned row, in the same aggregation."""
    usable = F.col(value).isNotNull()
    ordering = F.when(usable, F.struct(F.col(time), -F.col(seq), F.col(value).alias("v")))
    return (
        df.groupBy(*keys)
        .agg(F.max(ordering).alias("_best"), F.min(time).alias("scan_min"), F.max(time).alias("scan_max"))
        .select(*keys, F.col("_best.v").alias(value), F.col(f"_best.{time}").alias(time), "scan_min", "scan_max")
    )


def latest_of_columns(
    df: DataFrame, keys: list[str], columns: list[str], time: str, seq: str, least_time=None
) -> DataFrame:
    """Latest value of each of several columns, in one pass and one shuffle."""
    if least_time is not None:
        df = df.where(F.col(time) >= F.lit(least_time))
    long = df.unpivot([*keys, time, seq], columns, "variable", "value")
    return latest_value(long, [*keys, "variable"], time=time, seq=seq)


def volatility(
    df: DataFrame, keys: list[str], order: list[Column], value: str = "value", window: int = 15, least: int = 5
) -> DataFrame:
    """Population deviation of the newest ``window`` values, where at least ``least`` exist.

    The row-number limit is applied on the map side, so at most ``window`` rows per key and
    task are shuffled.
    """
    newest = Window.partitionBy(*keys).orderBy(*order)
    recent = df.where(F.col(value).isNotNull()).withColumn("_rn", F.row_number().over(newest))
    recent = recent.where(F.col("_rn") <= window)
    out = recent.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(value).alias("volatility"))
    return out.where(F.col("n") >= least)


def event_exposure(
    events: DataFrame, universe: DataFrame, keys: list[str], amount: str, population: str, per: float = 100_000.0
) -> DataFrame:
    """Events per exposure unit.

    A key without events is a true zero; without a positive population the rate is missing.
    """
    sums = events.groupBy(*keys).agg(F.sum(amount).alias("amount"))
    total = F.coalesce(F.col("amount"), F.lit(0.0))
    rate = F.when(F.col(population) > 0, F.try_divide(total, F.col(population)) * F.lit(per))
    return universe.join(sums, keys, "left").select(*universe.columns, total.alias("amount"), rate.alias("rate"))


def category_weighted_sum(
    df: DataFrame, keys: list[str], category: str, size: str, weights: dict[str, float]
) -> DataFrame:
    """Sum of sizes weighted by category; a key seen only with weightless categories is a real 0."""
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.upper(F.trim(F.col(category))) == name, F.lit(float(w))).otherwise(weight)
    return df.groupBy(*keys).agg(F.sum(weight * F.coalesce(F.col(size), F.lit(0.0))).alias("weighted_size"))


def largest_per_key(shares: DataFrame, areas: DataFrame, area: str, key: str = "key", value: str = "share") -> DataFrame:
    """Areas as keys: the larger value where several areas map to one key; areas without a key are left out."""
    return shares.join(areas.where(F.col(key).isNotNull()), area).groupBy(key).agg(F.max(value).alias(value))


def channel_share(
    cells: DataFrame,
    area: str,
    group: str,
    sector: str,
    value: str,
    channels: dict[str, dict],
    total_sector: str,
) -> DataFrame:
    """Largest complete channel share per area.

    ``cells`` holds one value per (area, group, sector). A channel adds its required sectors
    and any reported optional ones, over the group total; it counts only when complete.
    """
    names, aggs, shares = [], [], []
    for g, spec in channels.items():
        for s in [total_sector, *spec["required"], *spec.get("optional", [])]:
            column = f"{g}|{s}"
            if column not in names:
                names.append(column)
                aggs.append(F.max(F.when((F.col(group) == g) & (F.col(sector) == s), F.col(value))).alias(column))
    wide = cells.groupBy(area).agg(*aggs)
    for g, spec in channels.items():
        at = lambda s, g=g: F.col(f"`{g}|{s}`")
        part = F.lit(0.0)
        for s in spec["required"]:
            part = part + at(s)
        for s in spec.get("optional", []):
            part = part + F.coalesce(at(s), F.lit(0.0))
        shares.append(F.when(at(total_sector) > 0, F.try_divide(part, at(total_sector))))
    best = F.greatest(*shares) if len(shares) > 1 else shares[0]
    return wide.select(area, F.least(F.lit(1.0), best).alias("_s"), best.isNotNull().alias("_has")).where("_has").select(
        area, F.col("_s").alias("share")
    )
