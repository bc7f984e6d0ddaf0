"""Row filters driven by configuration or intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dimension_filter(df: DataFrame, wanted: dict) -> DataFrame:
    """Equality filters from configuration; null wishes and absent columns are skipped."""
    tests = [F.col(c) == F.lit(v) for c, v in wanted.items() if v is not None and c in df.columns]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def stabbed_by(start: Column, end: Column, snapshot: Column) -> Column:
    """Intervals that contain a snapshot, ends included."""
    return snapshot.between(start, end)


def snapshots_in_interval(df: DataFrame, start: Column, end: Column, snapshots: list[int], name: str) -> DataFrame:
    """One row per (interval, snapshot inside it). The snapshot list is configuration, so each
    row filters its own copy instead of joining."""
    points = F.array(*[F.lit(int(s)) for s in snapshots])
    return df.withColumn(name, F.explode(F.filter(points, lambda s: (s >= start) & (s <= end))))


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Case-insensitive substring search over any of the columns."""
    needle = text.strip().lower()
    tests = [F.lower(F.col(c).cast("string")).contains(needle) for c in columns]
    return df.where(reduce(lambda a, b: a | b, tests))
