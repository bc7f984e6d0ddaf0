"""Scans of landed files. Every cell is read as text and converted by explicit rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compindex.functions import cleaning as K


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Files below a folder with size and date; contents stay unread."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.load(folder).select("path", "length", "modificationTime")


def table_paths(spark: SparkSession, folder: str) -> dict[str, str]:
    """Table name -> path for every ``name.csv`` (file or folder of parts) in a directory.

    One short row per table reaches the driver, as needed to plan one scan per schema.
    """
    entry = F.regexp_extract("path", r"/([^/]+)\.csv(?:/[^/]*)?$", 1)
    whole = F.regexp_extract("path", r"^(.*/[^/]+\.csv)(?:/[^/]*)?$", 1)
    rows = listing(spark, folder, "*.csv").select(entry.alias("name"), whole.alias("path")).distinct().orderBy("name")
    return {row["name"]: row["path"] for row in rows.collect() if row["name"]}


def text_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    return spark.read.option("header", str(header).lower()).csv(path)


def require_columns(df: DataFrame, names: list[str], what: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
    return df


def scan_processed(spark: SparkSession, folder: str, key: str = "key") -> DataFrame:
    """Every table of a directory as long signals (tbl, col, key, value).

    All other columns become numbers; a text column becomes nulls. Blank keys are dropped.
    """
    parts = []
    for name, path in table_paths(spark, folder).items():
        wide = require_columns(text_csv(spark, path), [key], name)
        columns = [c for c in wide.columns if c != key]
        wide = wide.where(K.usable_key(F.col(key)).isNotNull())
        long = wide.unpivot([key], columns, "col", "text")
        parts.append(long.select(F.lit(name).alias("tbl"), "col", F.trim(key).alias("key"), K.to_double(F.col("text")).alias("value")))
    if not parts:
        raise ValueError(f"no tables in {folder}")
    return reduce(DataFrame.unionByName, parts)


def scan_observations(spark: SparkSession, path: str, series: list[str]) -> DataFrame:
    """Cached observations of the named series; other partitions are not read."""
    return spark.read.parquet(path).where(F.col("series").isin(*series))


# Shapes of landed pages: JSON path of the row array.
PAGE_PATHS = {"pair": "$[1]", "items": "$.items", "value": "$.value"}


def scan_api_pages(spark: SparkSession, folder: str, shape: str, row_schema: str, lines: bool = False) -> DataFrame:
    """Rows of landed JSON pages: ``[meta, rows]``, ``{items: rows}`` or ``{value: rows}``.

    A page is one small file as it lands, or one line of a few large files, which Spark splits.
    """
    pages = spark.read.text(folder, wholetext=not lines)
    rows = F.from_json(F.get_json_object("value", PAGE_PATHS[shape]), f"array<struct<{row_schema}>>")
    return pages.select(F.inline(rows))


def scan_year_panel(spark: SparkSession, path: str, key: str, year: int) -> DataFrame:
    """One column per year to one value per key at the snapshot year; blanks are dropped."""
    wide = require_columns(text_csv(spark, path), [key, str(year)], path)
    rows = wide.select(F.trim(key).alias("key"), K.to_double(F.col(f"`{year}`")).alias("value"))
    return rows.where(F.col("key").isNotNull() & F.col("value").isNotNull())


def scan_panel_years(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The whole panel as (key, year, value), nulls kept."""
    wide = text_csv(spark, path)
    years = [c for c in wide.columns if c.strip().isdigit()]
    long = wide.unpivot([key], years, "year", "text")
    return long.select(F.col(key).alias("key"), F.col("year").cast("int").alias("year"), K.to_double(F.col("text")).alias("value"))


def scan_wide_csv(spark: SparkSession, path: str, key: str, columns: list[str], year: str, year_min: int) -> DataFrame:
    """A few columns of a very wide file from a first year on; the other columns are not parsed."""
    wide = require_columns(text_csv(spark, path), [key, year, *columns], path)
    when = K.to_year(F.col(year))
    return wide.select(
        F.trim(key).alias("key"), when.alias("year"), *[K.to_double(F.col(c)).alias(c) for c in columns]
    ).where(F.col("year") >= year_min)


def scan_sheet_export(
    spark: SparkSession, path: str, positions: dict[str, int], key: str, numeric: list[str], key_pattern: str = r"\S"
) -> DataFrame:
    """Columns by position below a header block; rows count when their key matches."""
    sheet = text_csv(spark, path, header=False)
    at = lambda name: F.col(sheet.columns[positions[name]])
    cells = [
        (K.to_double(at(n), K.SURVEY_NA_TOKENS, fold_case=False) if n in numeric else F.trim(at(n))).alias(n)
        for n in positions
    ]
    return sheet.where(F.coalesce(at(key).rlike(key_pattern), F.lit(False))).select(*cells)


def _features(spark: SparkSession, path: str, geometry: str, properties: str, lines: bool) -> DataFrame:
    geo = f"geometry struct<type: string, coordinates: {geometry}>"
    if lines:
        return spark.read.schema(f"type string, {geo}, properties struct<{properties}>").json(path)
    feature = f"type: string, {geo.replace('geometry ', 'geometry: ', 1)}, properties: struct<{properties}>"
    whole = spark.read.schema(f"features array<struct<{feature}>>").option("multiLine", "true").json(path)
    return whole.select(F.inline("features"))


def scan_geojson_points(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """Point features as lon, lat and the named properties.

    A feature collection is one document per file; large layers land one feature per line and
    are split over tasks with ``lines``.
    """
    points = _features(spark, path, "array<double>", properties, lines)
    coordinates = F.col("geometry.coordinates")
    return points.select(coordinates[0].alias("lon"), coordinates[1].alias("lat"), "properties.*").where(
        F.col("lon").isNotNull() & F.col("lat").isNotNull()
    )


def scan_polygons(spark: SparkSession, path: str, id_property: str, width: int = 6, lines: bool = True) -> DataFrame:
    """Polygon and multi-polygon features with a padded text id; features without an id are dropped.

    All parts' rings stand side by side, which crossing parity reads as it does holes. A feature without geometry
    has no rings; any other geometry type fails the job.
    """
    # the nesting depends on the type, so coordinates are read as text first
    shapes = _features(spark, path, "string", f"{id_property}: string", lines)
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    ring = "array<array<double>>"
    parts = (
        F.when(kind == "Polygon", F.from_json(text, f"array<{ring}>"))
        .when(kind == "MultiPolygon", F.flatten(F.from_json(text, f"array<array<{ring}>>")))
        .when(kind.isNotNull(), F.raise_error(F.concat(F.lit("not a polygon layer: "), kind)).cast(f"array<{ring}>"))
    )
    rings = F.transform(parts, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    raw = F.col(f"properties.{id_property}")
    return shapes.where(raw.isNotNull()).select(K.unit_id(raw, width).alias("id"), rings.alias("rings"))


def confirmed_specs(entries: dict[str, dict]) -> list[dict]:
    """Configured series that carry a code and are confirmed, as anchor specs."""
    return [
        {"series": name, **{k: v for k, v in entry.items() if k not in ("confirmed",)}}
        for name, entry in entries.items()
        if entry.get("code") and entry.get("confirmed") is True
    ]


def load_yaml(path: str) -> dict:
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading YAML configuration needs the yaml package") from error
    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle)


def inventory(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """sha256, size and date per file; files are hashed where they are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.load(folder).select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("bytes"), "modificationTime",
    )
