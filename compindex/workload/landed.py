"""Sources and sinks: tables are written in the landed formats, read back and checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from compindex.sources import cache as U
from compindex.sources import readers as S
from compindex.sources import writers as Y
from compindex.session import scratch_path
from compindex.workload import fixtures as X
from compindex.workload.registry import query


_SLOTS = [f"h{i}" for i in range(X.SLOTS)]
_TYPE_ROWS, _SLOT_ROWS = (f"(VALUES {', '.join(f'({v!r})' for v in names)})" for names in (X.TYPES, _SLOTS))


@query(
    "scan_processed",
    X.sql("sig uni", f"""SELECT t.tbl, t.col, CAST(u.key AS VARCHAR) AS key, round_even(s.value, 4) AS value FROM uni u CROSS JOIN (SELECT tbl, col FROM
      {_TYPE_ROWS} a(tbl), {_SLOT_ROWS} b(col)) t LEFT JOIN sig s ON s.key = u.key AND s.tbl = t.tbl AND s.col = t.col
      UNION ALL SELECT 'view', 'source', CAST(key AS VARCHAR), NULL FROM uni"""),
)
def scan_processed(spark, sf):
    """Wide tables written one folder per table, a text column among them, scanned back as signals."""
    folder = scratch_path(spark, "processed")
    signals, keys = X.signals(spark, sf), X.universe(spark, sf)
    for name in X.TYPES:
        wide = Y.wide_table(signals.where(F.col("tbl") == name), keys, _SLOTS)
        if name == "view":
            wide = wide.withColumn("source", F.lit("events"))
        Y.write_wide(wide, f"{folder}/{name}.csv", ["key"])
    return S.scan_processed(spark, folder)


@query(
    "write_wide",
    X.sql("sig uni", f"""SELECT u.key, {", ".join(f"round_even(max(value) FILTER (WHERE tbl = '{t}' AND col = '{c}'), 4) AS {t}_{c}" for t in X.TYPES for c in _SLOTS)}
      FROM uni u LEFT JOIN sig ON sig.key = u.key GROUP BY u.key"""),
)
def write_wide(spark, sf):
    path = scratch_path(spark, "wide")
    named = X.signals(spark, sf).withColumn("col", F.concat_ws("_", "tbl", "col"))
    wide = Y.wide_table(named, X.universe(spark, sf), [f"{t}_{c}" for t in X.TYPES for c in _SLOTS])
    Y.write_wide(wide, path, ["key"], "parquet")
    return spark.read.parquet(path)


# Features per collection, on average.
COLLECTION_ROWS = 500


def _cache(spark, sf, first_days=None):
    """Observation cache partitioned by series, from all events or those of the first days."""
    path = scratch_path(spark, "cache")
    rows = X.observations(spark, sf)
    rows = rows if first_days is None else rows.where(F.col("year") < first_days)
    names = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    old = rows.join(names, "key", "left").groupBy("key", "name", "year", "series").agg(F.max("value").alias("value"))
    U.write_cache(old, path)
    return path


_OLD = ("SELECT o.key, c.c_name AS name, o.year, o.series, max(value) AS value FROM obs o LEFT JOIN customer c ON c.c_custkey = o.key "
        "WHERE year < 20 GROUP BY ALL")


_ALL = _OLD.replace("WHERE year < 20 ", "")


@query("scan_observations", X.sql("obs", "SELECT * FROM old WHERE series IN ('view', 'click')", {"old": _ALL}))
def scan_observations(spark, sf):
    return S.scan_observations(spark, _cache(spark, sf), ["view", "click"]).select("key", "name", "year", "series", "value")


_NEW = ("SELECT key, year, series, CASE WHEN series <> 'error' THEN value END AS value FROM (SELECT key, year, series, max(value) AS value "
        "FROM obs WHERE year >= 10 AND series IN ('view', 'error') GROUP BY 1, 2, 3)")


def _upserted(spark, sf):
    """New rows for two series, without names; those of one series are all null and are refused."""
    path = _cache(spark, sf, 20)
    rows = X.observations(spark, sf).where((F.col("year") >= 10) & F.col("series").isin("view", "error"))
    new = rows.groupBy("key", "year", "series").agg(F.max("value").alias("value"))
    new = new.withColumn("value", F.when(F.col("series") != "error", F.col("value")))
    report = U.upsert_series(spark, path, new.withColumn("name", F.lit(None).cast("string")))
    return path, report


@query(
    "upsert_series",
    X.sql("obs", """SELECT key, name, year, series, value FROM old WHERE series <> 'view' UNION ALL
      SELECT n.key, o.name, n.year, n.series, n.value FROM new n LEFT JOIN (SELECT key, min(name) AS name FROM old GROUP BY key) o USING (key)
      WHERE n.series = 'view' AND n.value IS NOT NULL""", {"old": _OLD, "new": _NEW}),
)
def upsert_series(spark, sf):
    path, _ = _upserted(spark, sf)
    return spark.read.parquet(path).select("key", "name", "year", "series", "value")


@query("upsert_refusals", X.sql("obs", "SELECT series, count(value) AS n_values, count(*) AS n_rows, count(value) = 0 AS refused FROM new GROUP BY 1", {"new": _NEW}))
def upsert_refusals(spark, sf):
    return _upserted(spark, sf)[1].select("series", "n_values", "n_rows", "refused")


@query(
    "scan_api_pages",
    "SELECT o_custkey AS key, CAST(extract(year FROM o_orderdate) AS INTEGER) AS year, o_totalprice AS value, shape FROM orders, (VALUES ('pair'), ('items'), ('value')) t(shape)",
)
def scan_api_pages(spark, sf):
    """Orders landed as JSON pages of each shape, about a hundred rows to a page, a page to a line."""
    orders = X.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("value"),
        F.floor(F.col("o_orderkey") / 100).alias("page"),
    )
    pages = orders.groupBy("page").agg(F.to_json(F.collect_list(F.struct("key", "year", "value"))).alias("rows"))
    bodies = {
        "pair": F.concat(F.lit('[{"page":1},'), F.col("rows"), F.lit("]")),
        "items": F.concat(F.lit('{"items":'), F.col("rows"), F.lit("}")),
        "value": F.concat(F.lit('{"count":1,"value":'), F.col("rows"), F.lit("}")),
    }
    out = None
    for shape, body in bodies.items():
        folder = scratch_path(spark, f"pages-{shape}")
        pages.select(body.alias("value")).write.text(folder)
        part = S.scan_api_pages(spark, folder, shape, "key: bigint, year: int, value: double", lines=True).withColumn("shape", F.lit(shape))
        out = part if out is None else out.unionByName(part)
    return out


def _panel(spark, sf):
    """Supplier by ship year, one text column per year."""
    path = scratch_path(spark, "panel")
    rows = X.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("code"), F.year("l_shipdate").alias("y"), "l_quantity")
    span = rows.agg(F.min("y").alias("low"), F.max("y").alias("high")).first()
    wide = rows.groupBy("code").agg(
        *[F.sum(F.when(F.col("y") == y, F.col("l_quantity"))).alias(str(y)) for y in range(span["low"], span["high"] + 1)]
    )
    Y.write_wide(wide.withColumn("label", F.lit("text")), path, ["code"])
    return path


_PANEL_SQL = "SELECT l_suppkey AS code, extract(year FROM l_shipdate) AS y, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"


@query("scan_year_panel", f"SELECT CAST(code AS VARCHAR) AS key, v AS value FROM ({_PANEL_SQL}) WHERE y = 1997 AND v IS NOT NULL")
def scan_year_panel(spark, sf):
    return S.scan_year_panel(spark, _panel(spark, sf), "code", 1997)


@query(
    "scan_panel_years",
    f"""SELECT CAST(s.code AS VARCHAR) AS key, CAST(years.y AS INTEGER) AS year, p.v AS value FROM (SELECT DISTINCT l_suppkey AS code FROM lineitem) s
      CROSS JOIN (SELECT unnest(range(min(extract(year FROM l_shipdate)), max(extract(year FROM l_shipdate)) + 1)) AS y FROM lineitem) years LEFT JOIN ({_PANEL_SQL}) p ON p.code = s.code AND p.y = years.y""",
)
def scan_panel_years(spark, sf):
    return S.scan_panel_years(spark, _panel(spark, sf), "code")


@query(
    "scan_wide_csv",
    """SELECT CAST(l_suppkey AS VARCHAR) AS key, CAST(extract(year FROM l_shipdate) AS INTEGER) AS year, l_quantity, l_discount FROM lineitem
      WHERE extract(year FROM l_shipdate) >= 1998""",
)
def scan_wide_csv(spark, sf):
    path = scratch_path(spark, "wide-csv")
    rows = X.table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate").cast("string"))
    rows.write.option("header", "true").csv(path)
    return S.scan_wide_csv(spark, path, "l_suppkey", ["l_quantity", "l_discount"], "year", 1998)


@query(
    "scan_sheet_export",
    """SELECT c_name AS name, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS balance FROM customer""",
)
def scan_sheet_export(spark, sf):
    """A sheet with a title block on top and text cells among the numbers."""
    path = scratch_path(spark, "sheet")
    rows = X.table(spark, sf, "customer").select(
        F.lit(None).cast("string").alias("a"), F.col("c_name").alias("b"), F.lit("unused").alias("c"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal").cast("string")).otherwise("N/A").alias("d"),
    )
    title = X.table(spark, sf, "region").select(
        F.col("r_name").alias("a"), F.lit(None).cast("string").alias("b"), F.lit("notes").alias("c"), F.lit("value").alias("d")
    )
    title.unionByName(rows).write.csv(path)
    return S.scan_sheet_export(spark, path, {"name": 1, "balance": 3}, "name", ["balance"], r"^Customer#")


def _point_lines(spark, sf):
    rows = X.located(X.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")))
    return Y.geojson_features(rows, F.array("lon", "lat"), "Point", ["key", "name"])


@query(
    "scan_geojson_points",
    X.sql("pts", "SELECT key, c_name AS name, lon, lat, layout FROM pts JOIN customer ON c_custkey = key, (VALUES ('lines'), ('collection')) t(layout)"),
)
def scan_geojson_points(spark, sf):
    """Points as one feature per line, and as feature collections of bounded size."""
    lines = scratch_path(spark, "points")
    Y.write_lines(_point_lines(spark, sf), lines)
    whole = scratch_path(spark, "collections")
    rows = spark.read.text(lines)
    # a collection is one document, so their number grows with the points
    parts = rows.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(rows.count() // COLLECTION_ROWS + 1)))
    body = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}"))
    parts.groupBy("part").agg(body.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(whole)
    a = S.scan_geojson_points(spark, lines, "key: bigint, name: string", lines=True).withColumn("layout", F.lit("lines"))
    b = S.scan_geojson_points(spark, whole, "key: bigint, name: string").withColumn("layout", F.lit("collection"))
    return a.unionByName(b)


@query(
    "scan_polygons",
    """SELECT lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS id, CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 1 END AS n_rings, CASE WHEN n_nationkey % 3 = 0 THEN 10 ELSE 5 END AS n_corners
      FROM nation WHERE n_nationkey <> 7""",
)
def scan_polygons(spark, sf):
    """Polygons written as features; ids lose their decimals and gain zeros, a missing id drops the feature."""
    from compindex.workload.spatial import polygons

    path = scratch_path(spark, "polygons")
    raw_id = F.when(F.col("id") != 7, F.concat(F.col("id").cast("string"), F.lit(".0")))
    shapes = polygons(spark, sf).withColumn("GEOID", raw_id)
    Y.write_lines(Y.geojson_features(shapes, Y.polygon_coordinates(F.col("rings")), "Polygon", ["GEOID"]), path)
    read = S.scan_polygons(spark, path, "GEOID")
    return read.select("id", F.size("rings").alias("n_rings"), F.size(F.flatten("rings")).alias("n_corners"))


@query(
    "write_json_docs",
    X.sql("comp", "SELECT key, round(composite, 4) AS composite, composite IS NOT NULL AS scored FROM comp"),
)
def write_json_docs(spark, sf):
    """Score documents as JSON, read back; a NaN would fail the write."""
    path = scratch_path(spark, "docs")
    docs = X.composite(spark, sf).select("key", F.round("composite", 4).alias("composite"), F.col("composite").isNotNull().alias("scored"))
    Y.write_json_docs(docs, path)
    return spark.read.schema("key bigint, composite double, scored boolean").json(path)


@query(
    "content_inventory",
    """SELECT CAST(p_size AS VARCHAR) AS size_class, sha256(CAST(count(*) AS VARCHAR) || chr(10)) AS sha256, length(CAST(count(*) AS VARCHAR)) + 1 AS bytes FROM part GROUP BY p_size""",
)
def content_inventory(spark, sf):
    """Hash and size of files: one short file per size class of parts."""
    folder = scratch_path(spark, "inventory")
    counts = X.table(spark, sf, "part").groupBy(F.col("p_size").cast("string").alias("size_class")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    counts.repartition("size_class").write.partitionBy("size_class").text(folder)
    return S.inventory(spark, folder, "*.txt").select(
        F.regexp_extract("path", r"size_class=([^/]+)/", 1).alias("size_class"), "sha256", "bytes"
    )


# --- the register ----------------------------------------------------------------------


def register(spark, sf):
    """A register of parts: indicator = part name, source = brand, fragment order = size, then key."""
    return X.table(spark, sf, "part").select(
        F.col("p_name").alias("indicator"), F.col("p_brand").alias("source"), F.col("p_size").alias("fragment"),
        F.col("p_partkey").alias("pos"), F.col("p_retailprice").alias("anchor"),
    )


_MERGED = """SELECT indicator, source, fragment, pos, anchor FROM (SELECT p_name AS indicator, p_brand AS source, p_size AS fragment, p_partkey AS pos, p_retailprice AS anchor,
  row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_size, p_partkey) AS rn FROM part WHERE p_name NOT LIKE 'red%') WHERE rn = 1"""


@query("register_merge", _MERGED)
def register_merge(spark, sf):
    rows = register(spark, sf)
    dropped = rows.where(F.col("indicator").startswith("red")).select("indicator", "source").distinct()
    return U.merged_fragments(rows, ["indicator", "source"], ["fragment", "pos"], dropped)


@query(
    "register_upsert",
    """WITH old AS (SELECT p_name AS indicator, p_brand AS source, min(p_retailprice) AS anchor FROM part WHERE p_size <= 25 GROUP BY 1, 2),
      new AS (SELECT p_name AS indicator, p_brand AS source, max(p_retailprice) AS anchor FROM part WHERE p_size > 25 GROUP BY 1, 2)
    SELECT * FROM new UNION ALL SELECT * FROM old WHERE (indicator, source) NOT IN (SELECT (indicator, source) FROM new)""",
)
def register_upsert(spark, sf):
    rows, keys = register(spark, sf), ["indicator", "source"]
    old = rows.where(F.col("fragment") <= 25).groupBy(*keys).agg(F.min("anchor").alias("anchor"))
    new = rows.where(F.col("fragment") > 25).groupBy(*keys).agg(F.max("anchor").alias("anchor"))
    once = U.upsert_rows(old, new, keys)
    return U.upsert_rows(once, new, keys)


@query(
    "aligned_union",
    """SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL
      SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer""",
)
def aligned_union(spark, sf):
    """Row sets with different columns, aligned by name."""
    a = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)
