"""Keyed upserts: the observation cache and the series register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compindex.operators import ranking as R
from compindex.session import cut_lineage

CACHE_COLUMNS = ("key", "name", "year", "value", "series")


def usable_series(rows: DataFrame) -> DataFrame:
    """Per series: usable rows, and whether the series is refused for having none."""
    return rows.groupBy("series").agg(F.count("value").alias("n_values"), F.count(F.lit(1)).alias("n_rows")).withColumn(
        "refused", F.col("n_values") == 0
    )


def merged_series(existing: DataFrame | None, rows: DataFrame) -> DataFrame:
    """New content of the named series: no null values, missing names from the existing cache.

    A series whose new rows are all null is left out, so its old rows survive.
    """
    usable = rows.where(F.col("value").isNotNull())
    if existing is not None:
        names = existing.where(F.col("name").isNotNull()).groupBy("key").agg(F.min("name").alias("_name"))
        usable = usable.join(names, "key", "left").withColumn("name", F.coalesce("name", "_name")).drop("_name")
    return usable.select(*CACHE_COLUMNS)


def write_cache(df: DataFrame, path: str) -> None:
    """Partitioned by series; only the partitions present in ``df`` are replaced.

    Ranges of (series, key) keep a task to few series, and split a series that holds most rows.
    """
    ordered = df.select(*CACHE_COLUMNS).repartitionByRange("series", "key").sortWithinPartitions("series", "key", "year")
    writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("series").parquet(path)


def upsert_series(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Replace the named series of the cache at ``path``; returns the acceptance report."""
    rows = cut_lineage(rows.select(*CACHE_COLUMNS))
    report = cut_lineage(usable_series(rows))
    merged = cut_lineage(merged_series(spark.read.parquet(path), rows))
    write_cache(merged, path)
    return report


def upsert_rows(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows with the same keys; repeating it changes nothing."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def merged_fragments(fragments: DataFrame, keys: list[str], order: list[str], dropped: DataFrame | None = None) -> DataFrame:
    """First row per key in fragment order; keys on the drop list are excluded."""
    kept = fragments if dropped is None else fragments.join(dropped.select(*keys), keys, "left_anti")
    return R.first_wins(kept, keys, [F.col(c) for c in order])
