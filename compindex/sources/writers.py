"""Sinks: wide tables, JSON documents and GeoJSON features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wide_table(signals: DataFrame, universe: DataFrame, columns: list[str], digits: int = 4, key: str = "key") -> DataFrame:
    """One row per universe key and one rounded column per signal; missing stays null."""
    picks = [F.max(F.when(F.col("col") == c, F.col("value"))).alias(c) for c in columns]
    wide = signals.groupBy(key).agg(*picks)
    return universe.select(key).join(wide, key, "left").select(key, *[F.bround(c, digits).alias(c) for c in columns])


def write_wide(df: DataFrame, path: str, order: list[str], fmt: str = "csv") -> None:
    """Sorted by universe order; blanks stand for nulls in text files."""
    ordered = df.orderBy(*order)
    if fmt == "csv":
        ordered.write.mode("overwrite").option("header", "true").csv(path)
    else:
        ordered.write.mode("overwrite").format(fmt).save(path)


def _floats(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind in ("double", "float")]


def strict(df: DataFrame) -> DataFrame:
    """The same rows, or a failed job where a number is NaN or infinite."""
    def checked(name: str) -> Column:
        bad = F.isnan(name) | F.col(name).isin(float("inf"), float("-inf"))
        return F.when(bad, F.raise_error(F.lit(f"not a number in column {name}"))).otherwise(F.col(name)).alias(name)

    floats = _floats(df)
    return df.select(*[checked(c) if c in floats else F.col(c) for c in df.columns])


def lenient(df: DataFrame) -> DataFrame:
    """NaN and infinities become null."""
    def cleaned(name: str) -> Column:
        bad = F.isnan(name) | F.col(name).isin(float("inf"), float("-inf"))
        return F.when(~bad, F.col(name)).alias(name)

    floats = _floats(df)
    return df.select(*[cleaned(c) if c in floats else F.col(c) for c in df.columns])


def json_docs(df: DataFrame, fail_on_nan: bool = True) -> DataFrame:
    """One JSON document per row."""
    safe = strict(df) if fail_on_nan else lenient(df)
    return safe.select(F.to_json(F.struct(*safe.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json_docs(df: DataFrame, path: str, fail_on_nan: bool = True) -> None:
    json_docs(df, fail_on_nan).write.mode("overwrite").text(path)


def geojson_features(df: DataFrame, geometry: Column, kind: str, properties: list[str]) -> DataFrame:
    """One feature per row and line."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit(kind).alias("type"), geometry.alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def polygon_coordinates(rings: Column) -> Column:
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))


def write_lines(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)
