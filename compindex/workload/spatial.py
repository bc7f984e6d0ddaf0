"""Containment, contiguity, bands, neighbours, hot spots and local association."""

from __future__ import annotations

from pyspark.sql import functions as F

from compindex.functions import labels as B
from compindex.functions import noise as Z
from compindex.operators import association as M
from compindex.operators import scale as N
from compindex.operators import spatial as G
from compindex.operators import stats as T
from compindex.session import cut_lineage
from compindex.workload import fixtures as X
from compindex.workload.core import r8
from compindex.workload.registry import query

# Fixed value: permutations of the published association tests.
PERMS = 999
SEED = 42


def points(spark, sf):
    """Customers as located points with nation and balance."""
    rows = X.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("x")
    )
    return X.located(rows)


def polygons(spark, sf):
    """One square per nation on a 5 x 5 grid; every third has a hole, and two shrink so that
    they touch nothing."""
    n = F.col("n_nationkey")
    shrunk = (n == 6) | (n == 18)
    inset = F.when(shrunk, 5.0).otherwise(0.0)
    x0, y0 = (n % 5) * 72.0 - 180.0, F.floor(n / 5) * 28.0 - 70.0

    def square(left, bottom, right, top):
        corners = [(left, bottom), (right, bottom), (right, top), (left, top), (left, bottom)]
        return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in corners])

    outer = square(x0 + inset, y0 + inset, x0 + 72.0 - inset, y0 + 28.0 - inset)
    hole = square(x0 + 24.0, y0 + 8.0, x0 + 40.0, y0 + 16.0)
    rings = F.when(n % 3 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    return X.table(spark, sf, "nation").select(n.cast("long").alias("id"), rings.alias("rings"))


_BOX = """SELECT n_nationkey AS id, (n_nationkey % 5) * 72.0 - 180.0 AS x0, floor(n_nationkey / 5) * 28.0 - 70.0 AS y0,
  CASE WHEN n_nationkey IN (6, 18) THEN 5.0 ELSE 0.0 END AS inset FROM nation"""
_INSIDE = """p.lon > x0 + inset AND p.lon < x0 + 72 - inset AND p.lat > y0 + inset AND p.lat < y0 + 28 - inset AND NOT
  (id % 3 = 0 AND p.lon BETWEEN x0 + 24 AND x0 + 40 AND p.lat BETWEEN y0 + 8 AND y0 + 16)"""
_CORNERS = """SELECT id, x0 + inset AS x, y0 + inset AS y FROM box UNION ALL SELECT id, x0 + 72 - inset, y0 + inset FROM box
  UNION ALL SELECT id, x0 + 72 - inset, y0 + 28 - inset FROM box UNION ALL SELECT id, x0 + inset, y0 + 28 - inset FROM box
  UNION ALL SELECT id, x0 + 24, y0 + 8 FROM box WHERE id % 3 = 0 UNION ALL SELECT id, x0 + 40, y0 + 8 FROM box WHERE id % 3 = 0
  UNION ALL SELECT id, x0 + 40, y0 + 16 FROM box WHERE id % 3 = 0 UNION ALL SELECT id, x0 + 24, y0 + 16 FROM box WHERE id % 3 = 0"""
_QUEEN = {
    "box": _BOX, "corner": _CORNERS,
    "adj": "SELECT DISTINCT a.id AS i, b.id AS j FROM corner a JOIN corner b ON a.x = b.x AND a.y = b.y AND a.id <> b.id",
    "unit": "SELECT CAST(n_nationkey AS BIGINT) AS id, (SELECT avg(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS y FROM nation",
    "zed": "SELECT id, y, y - (SELECT avg(y) FROM unit) AS z, (SELECT count(y) FROM unit) AS n, (SELECT sum((y - m) * (y - m)) FROM unit, (SELECT avg(y) AS m FROM unit)) AS ss FROM unit WHERE y IS NOT NULL",
    "lag": "SELECT zed.id, any_value(zed.y) AS y, any_value(zed.z) AS z, any_value(zed.n) AS n, any_value(zed.ss) AS ss, count(o.id) AS k, coalesce(avg(o.z), 0.0) AS lag "
           "FROM zed LEFT JOIN adj ON adj.i = zed.id LEFT JOIN zed o ON o.id = adj.j GROUP BY zed.id",
}


def unit_means(spark, sf):
    means = X.table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(F.avg("c_acctbal").alias("y"))
    return X.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id")).join(means, "id", "left")


@query("bounding_box", X.sql("pts", "SELECT key, lon, lat FROM pts WHERE lat BETWEEN -60 AND 84 AND lon BETWEEN -180 AND 180"))
def bounding_box(spark, sf):
    from compindex.functions.geo import in_box

    return points(spark, sf).where(in_box(F.col("lon"), F.col("lat"))).select("key", "lon", "lat")


@query("point_in_polygon", X.sql("pts", f"SELECT p.key, box.id AS unit FROM pts p JOIN box ON {_INSIDE}", {"box": _BOX}))
def point_in_polygon(spark, sf):
    return G.points_within(points(spark, sf), polygons(spark, sf)).select("key", "unit")


@query(
    "events_per_polygon",
    X.sql("pts", f"SELECT box.id AS unit, count(*) AS events, count(DISTINCT p.key % 7) AS years FROM pts p JOIN box ON {_INSIDE} GROUP BY 1", {"box": _BOX}),
)
def events_per_polygon(spark, sf):
    matched = G.points_within(points(spark, sf), polygons(spark, sf)).withColumn("year", F.col("key") % 7)
    return G.unit_events(matched, "year")


@query("queen_contiguity", X.sql("", "SELECT i, j, round(CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY i), 8) AS w FROM adj", _QUEEN))
def queen_contiguity(spark, sf):
    return G.queen_edges(polygons(spark, sf)).select("i", "j", r8("w"))


@query(
    "queen_moran",
    X.sql("", """SELECT max(n) AS n, count(*) FILTER (WHERE k = 0) AS n_isolates,
      round(max(n) * sum(z * lag) / (count(*) FILTER (WHERE k > 0) * max(ss)), 8) AS moran_i FROM lag""", _QUEEN),
)
def queen_moran(spark, sf):
    base = cut_lineage(M.centred(unit_means(spark, sf), []))
    edges = M.kept_edges(G.queen_edges(polygons(spark, sf)), base, [])
    return M.moran(M.lagged(base, edges, []), []).select("n", "n_isolates", r8("moran_i"))


_PERM = {
    **_QUEEN,
    "drawn": f"SELECT id, z, perm, {Z.mixed_sql('perm', 'id', SEED)} AS h FROM zed, (SELECT unnest(range(1, {PERMS + 1})) AS perm)",
    "placed": "SELECT id, z, perm, row_number() OVER (PARTITION BY perm ORDER BY h, id) AS place FROM drawn",
}


_MORAN_PERM_SQL = f"""SELECT o.n, round(o.i, 8) AS moran_i, round((o.i - s.m) / s.sd, 6) AS z_sim, round((least(s.c, {PERMS} - s.c) + 1) / {PERMS + 1}.0, 8) AS p_sim
      FROM obs o, (SELECT count(*) FILTER (WHERE sim >= (SELECT i FROM obs) - 1e-12) AS c, avg(sim) AS m, stddev_pop(sim) AS sd FROM sims) s"""


_SIMS = {
       "obs": "SELECT max(n) AS n, max(n) * sum(z * lag) / (count(*) FILTER (WHERE k > 0) * max(ss)) AS i FROM lag",
       "seat": "SELECT id, row_number() OVER (ORDER BY id) AS place FROM zed",
       "seated": "SELECT p.perm, s.id, p.z FROM placed p JOIN seat s USING (place)",
       "deg": "SELECT i, count(*) AS k FROM adj GROUP BY i",
       "sims": "SELECT a.perm, (SELECT max(n) FROM zed) * sum(a.z * b.z / deg.k) / ((SELECT count(*) FROM deg) * (SELECT max(ss) FROM zed)) AS sim "
               "FROM adj JOIN deg USING (i) JOIN seated a ON a.id = adj.i JOIN seated b ON b.id = adj.j AND b.perm = a.perm GROUP BY a.perm"}


@query(
    "moran_permutation_test",
    X.sql("", _MORAN_PERM_SQL,
      {**_PERM, **_SIMS}),
)
def moran_permutation_test(spark, sf):
    out = M.moran_permutations(unit_means(spark, sf), G.queen_edges(polygons(spark, sf)), PERMS, SEED)
    return out.select("n", r8("moran_i"), F.round("z_sim", 6).alias("z_sim"), r8("p_sim"))


_LOCAL = {
    **_PERM,
    "cond": "SELECT l.id, l.k, l.z, l.lag, l.n, l.ss, p.perm, p.z AS pz, row_number() OVER (PARTITION BY l.id, p.perm ORDER BY p.place) AS seat "
            "FROM lag l JOIN placed p ON p.id <> l.id WHERE l.k > 0",
    "sim": "SELECT id, perm, any_value(z) AS z, any_value(lag) AS lag, any_value(k) AS k, any_value(n) AS n, any_value(ss) AS ss, avg(pz) AS slag FROM cond WHERE seat <= k GROUP BY id, perm",
}
_BHSQL = """SELECT id, least(CAST(1 AS DOUBLE), min(p * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM
  (SELECT id, p, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS m FROM pv)"""


_LOCAL_MORAN_SQL = """SELECT l.id, round((l.n - 1) * l.z * l.lag / l.ss, 8) AS local_i,
      CASE WHEN z > 0 AND lag > 0 THEN 'High-High' WHEN z <= 0 AND lag > 0 THEN 'Low-High' WHEN z <= 0 THEN 'Low-Low' ELSE 'High-Low' END AS quadrant,
      round(pv.zs, 6) AS z_sim, round(pv.p, 8) AS p_raw, round(bh.q, 8) AS p_fdr,
      CASE WHEN l.k = 0 THEN 'Isolate (no neighbours)' WHEN pv.p < 0.05 THEN CASE WHEN z > 0 AND lag > 0 THEN 'High-High' WHEN z <= 0 AND lag > 0 THEN 'Low-High'
        WHEN z <= 0 THEN 'Low-Low' ELSE 'High-Low' END ELSE 'Not-Significant' END AS cluster_raw,
      CASE WHEN l.k = 0 THEN 'Isolate (no neighbours)' WHEN bh.q < 0.05 THEN CASE WHEN z > 0 AND lag > 0 THEN 'High-High' WHEN z <= 0 AND lag > 0 THEN 'Low-High'
        WHEN z <= 0 THEN 'Low-Low' ELSE 'High-Low' END ELSE 'Not-Significant' END AS cluster_fdr
      FROM lag l LEFT JOIN pv USING (id) LEFT JOIN bh USING (id)"""


_LOCAL_P = {
       "pv": f"SELECT id, (least(c, {PERMS} - c) + 1) / {PERMS + 1}.0 AS p, zs FROM (SELECT id, count(*) FILTER (WHERE (n - 1) / ss * z * slag >= (n - 1) / ss * z * lag - 1e-12) AS c, "
             "any_value((n - 1) / ss * z * lag) AS i0, (any_value((n - 1) / ss * z * lag) - avg((n - 1) / ss * z * slag)) / stddev_pop((n - 1) / ss * z * slag) AS zs FROM sim GROUP BY id)",
       "bh": _BHSQL}


@query(
    "local_moran",
    X.sql("", _LOCAL_MORAN_SQL,
      {**_LOCAL, **_LOCAL_P}),
)
def local_moran(spark, sf):
    out = M.local_moran(unit_means(spark, sf), G.queen_edges(polygons(spark, sf)), [], PERMS, SEED)
    return out.select("id", r8("local_i"), "quadrant", F.round("z_sim", 6).alias("z_sim"), r8("p_raw"), r8("p_fdr"), "cluster_raw", "cluster_fdr")


@query(
    "cluster_counts",
    X.sql("", """SELECT cluster, count(*) AS n FROM (SELECT CASE WHEN l.k = 0 THEN 'Isolate (no neighbours)' WHEN pv.p < 0.05 THEN CASE WHEN z > 0 AND lag > 0 THEN 'High-High'
        WHEN z <= 0 AND lag > 0 THEN 'Low-High' WHEN z <= 0 THEN 'Low-Low' ELSE 'High-Low' END ELSE 'Not-Significant' END AS cluster FROM lag l LEFT JOIN pv USING (id)) GROUP BY 1""",
      {**_LOCAL, "pv": f"SELECT id, (least(c, {PERMS} - c) + 1) / {PERMS + 1}.0 AS p FROM (SELECT id, count(*) FILTER (WHERE z * slag >= z * lag - 1e-12 * ss / (n - 1)) AS c FROM sim GROUP BY id)"}),
)
def cluster_counts(spark, sf):
    out = M.local_moran(unit_means(spark, sf), G.queen_edges(polygons(spark, sf)), [], PERMS, SEED)
    return out.groupBy(F.col("cluster_raw").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


_GI_SQL = """SELECT l.id, round((z + lag * k) / (k + 1) / (sqrt(ss / n) * sqrt((n / (k + 1) - 1) / (n - 1))), 8) AS gistar_z, round(pv.p, 8) AS gistar_p, round(bh.q, 8) AS gistar_p_fdr,
      CASE WHEN k = 0 THEN 'Isolate (no neighbours)' WHEN bh.q >= 0.05 THEN 'Not-Significant' WHEN (z + lag * k) > 0 THEN 'Hot-Spot' ELSE 'Cold-Spot' END AS gistar_cluster
      FROM lag l LEFT JOIN pv USING (id) LEFT JOIN bh USING (id)"""


_GI_P = { "pv": f"SELECT id, (least(c, {PERMS} - c) + 1) / {PERMS + 1}.0 AS p FROM (SELECT id, count(*) FILTER (WHERE (z + slag * k) / (k + 1) >= (z + lag * k) / (k + 1) - 1e-12 * sqrt(ss / n)) AS c FROM sim GROUP BY id)",
       "bh": _BHSQL}


@query(
    "contiguity_gi_star",
    X.sql("", _GI_SQL,
      {**_LOCAL, **_GI_P}),
)
def contiguity_gi_star(spark, sf):
    out = M.local_gi_star(unit_means(spark, sf), G.queen_edges(polygons(spark, sf)), [], PERMS, SEED)
    return out.select("id", r8("gistar_z"), r8("gistar_p"), r8("gistar_p_fdr"), "gistar_cluster")


_DISC = {**{k: v for k, v in _QUEEN.items() if k in ("box", "corner", "adj")},
       "val": "SELECT CAST(n_nationkey AS BIGINT) AS id, (SELECT avg(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS composite, "
              "(SELECT avg(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey) AS g FROM nation",
       "ok": "SELECT * FROM val WHERE composite IS NOT NULL AND g IS NOT NULL",
       "lay": "SELECT id, 'composite' AS layer, composite AS y FROM ok UNION ALL SELECT id, 'reference', g FROM ok UNION ALL "
              "SELECT id, 'residual', composite - ((SELECT regr_slope(composite, g) FROM ok) * g + (SELECT regr_intercept(composite, g) FROM ok)) FROM ok",
       "zz": "SELECT layer, id, y - avg(y) OVER w AS z, count(*) OVER w AS n, var_pop(y) OVER w * count(*) OVER w AS ss FROM lay WINDOW w AS (PARTITION BY layer)",
       "ll": "SELECT zz.layer, zz.id, any_value(zz.z) AS z, any_value(zz.n) AS n, any_value(zz.ss) AS ss, count(o.id) AS k, coalesce(avg(o.z), 0.0) AS lag FROM zz "
             "LEFT JOIN adj ON adj.i = zz.id LEFT JOIN zz o ON o.id = adj.j AND o.layer = zz.layer GROUP BY zz.layer, zz.id"}


@query("discriminant_moran", X.sql("", """SELECT layer, n, round(i, 8) AS moran_i, round(i / max(CASE WHEN layer = 'composite' THEN i END) OVER (), 8) AS retained FROM (
      SELECT layer, max(n) AS n, max(n) * sum(z * lag) / (count(*) FILTER (WHERE k > 0) * max(ss)) AS i FROM ll GROUP BY layer)""",
      _DISC))
def discriminant_moran(spark, sf):
    shares = M.discriminant_moran(M.discriminant_layers(_discriminant_values(spark, sf)), G.queen_edges(polygons(spark, sf)))
    return shares.select("layer", "n", r8("moran_i"), r8("retained"))


def _discriminant_values(spark, sf):
    ref = X.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("id")).agg(F.avg("s_acctbal").alias("g"))
    return unit_means(spark, sf).withColumnRenamed("y", "composite").join(ref, "id", "left")


_DISC_LOCAL = {
    **_DISC,
    "drawn": f"SELECT layer, id, z, perm, {Z.mixed_sql('perm', 'id', SEED)} AS h FROM zz, (SELECT unnest(range(1, {PERMS + 1})) AS perm)",
    "placed": "SELECT layer, id, z, perm, row_number() OVER (PARTITION BY layer, perm ORDER BY h, id) AS place FROM drawn",
    "cond": "SELECT l.layer, l.id, l.k, l.z, l.lag, l.n, l.ss, p.perm, p.z AS pz, row_number() OVER (PARTITION BY l.layer, l.id, p.perm ORDER BY p.place) AS seat "
            "FROM ll l JOIN placed p ON p.layer = l.layer AND p.id <> l.id WHERE l.k > 0",
    "sim": "SELECT layer, id, perm, any_value(z) AS z, any_value(lag) AS lag, any_value(n) AS n, any_value(ss) AS ss, avg(pz) AS slag FROM cond WHERE seat <= k GROUP BY layer, id, perm",
    "pv": f"SELECT layer, id, any_value(z) AS z, any_value(lag) AS lag, (least(count(*) FILTER (WHERE z * slag >= z * lag - 1e-12 * ss / (n - 1)), {PERMS} - count(*) FILTER "
          f"(WHERE z * slag >= z * lag - 1e-12 * ss / (n - 1))) + 1) / {PERMS + 1}.0 AS p FROM sim GROUP BY layer, id",
    "bh": "SELECT layer, id, z, lag, least(1.0, min(p * m / i) OVER (PARTITION BY layer ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY p, id) AS i, "
          "count(*) OVER (PARTITION BY layer) AS m FROM pv)",
    "hh": "SELECT id, bool_or(layer = 'composite' AND h) AS a, bool_or(layer = 'reference' AND h) AS b, bool_or(layer = 'residual' AND h) AS c FROM (SELECT layer, id, q < 0.05 AND z > 0 AND lag > 0 AS h FROM bh) GROUP BY id",
}


_SETS_SQL = """SELECT count(*) FILTER (WHERE a) AS n_composite, count(*) FILTER (WHERE b) AS n_reference, count(*) FILTER (WHERE c) AS n_residual, count(*) FILTER (WHERE a AND c) AS n_surviving,
      count(*) FILTER (WHERE a AND b AND NOT c) AS n_explained, coalesce(CAST(count(*) FILTER (WHERE a AND b) AS DOUBLE) / nullif(count(*) FILTER (WHERE a OR b), 0), CAST(0 AS DOUBLE)) AS jaccard FROM hh"""


@query(
    "discriminant_sets",
    X.sql("", _SETS_SQL, _DISC_LOCAL),
)
def discriminant_sets(spark, sf):
    """Survivors of the High-High set and the Jaccard overlap with the reference set."""
    layers = M.discriminant_layers(_discriminant_values(spark, sf))
    sets = M.discriminant_sets(layers, G.queen_edges(polygons(spark, sf)), PERMS, SEED)
    both = F.count_if(F.col("in_composite") & F.col("in_reference"))
    either = F.count_if(F.col("in_composite") | F.col("in_reference"))
    return sets.agg(
        F.count_if("in_composite").alias("n_composite"), F.count_if("in_reference").alias("n_reference"),
        F.count_if("in_residual").alias("n_residual"),
        F.count_if(F.col("in_composite") & F.col("in_residual")).alias("n_surviving"),
        F.count_if(F.col("in_composite") & F.col("in_reference") & ~F.col("in_residual")).alias("n_explained"),
        F.coalesce(F.try_divide(both.cast("double"), either), F.lit(0.0)).alias("jaccard"),
    )


@query(
    "same_group_moran",
    """WITH t AS (SELECT c_nationkey AS g, c_acctbal - (SELECT avg(c_acctbal) FROM customer) AS z FROM customer)
    SELECT (SELECT count(*) FROM t) AS n, round((SELECT count(*) FROM t) * sum(a.z * b.z) / (count(*) * (SELECT sum(z * z) FROM t)), 8) AS moran_i
    FROM (SELECT *, row_number() OVER () AS r FROM t) a JOIN (SELECT *, row_number() OVER () AS r FROM t) b ON a.g = b.g AND a.r <> b.r""",
)
def same_group_moran(spark, sf):
    rows = X.table(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("v"))
    return M.group_moran(rows, "g", "v").select("n", r8("moran_i"))


_HAV = X.haversine_sql("a.lon", "a.lat", "b.lon", "b.lat")
_XW = "CAST(1 AS DOUBLE) + log10(CAST(1 AS DOUBLE) + greatest(x, CAST(0 AS DOUBLE)))"


@query(
    "band_gi_star",
    X.sql("pts", f"""SELECT lon, lat, count(*) AS n_points, round(any_value(n_near), 4) AS n_near, round(any_value(z), 6) AS gi_z,
      CASE WHEN any_value(z) >= 2.58 THEN '99%' WHEN any_value(z) >= 1.96 THEN '95%' WHEN any_value(z) >= 1.65 THEN '90%' ELSE 'ns' END AS hot FROM
      (SELECT key, lon, lat, n_near, CASE WHEN sc > 0 THEN (sx - m * n_near) / sc ELSE 0 END AS z FROM (SELECT g.*, s.m, s.sd * sqrt((s.n * n_near - n_near * n_near) / (s.n - 1)) AS sc FROM
        (SELECT a.key, any_value(a.lon) AS lon, any_value(a.lat) AS lat, CAST(count(*) AS DOUBLE) AS n_near, sum(b.w) AS sx FROM w a JOIN w b ON {_HAV} <= 500 GROUP BY a.key) g,
        (SELECT CAST(count(*) AS DOUBLE) AS n, avg(w) AS m, stddev_pop(w) AS sd FROM w) s)) GROUP BY lon, lat""",
      {"w": f"SELECT key, lon, lat, {_XW} AS w FROM pts"}),
)
def band_gi_star(spark, sf):
    from compindex.functions.scaling import severity_weight

    rows = points(spark, sf).withColumn("w", severity_weight(F.col("x")))
    rows = cut_lineage(rows.select("key", "lon", "lat", "w"))
    out = G.band_gi_star(rows, F.col("w"))
    counts = rows.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("n_points"))
    out = counts.join(out, ["lon", "lat"])
    return out.select("lon", "lat", "n_points", F.round("n_near", 4).alias("n_near"), F.round("gi_z", 6).alias("gi_z"), B.z_class(F.col("gi_z")).alias("hot"))


@query(
    "hot_spot_counts",
    X.sql("pts", f"""SELECT nation, count(*) AS n FROM (SELECT g.nation, (sx - s.m * n_near) / (s.sd * sqrt((s.n * n_near - n_near * n_near) / (s.n - 1))) AS z FROM
        (SELECT a.key, any_value(a.nation) AS nation, CAST(count(*) AS DOUBLE) AS n_near, sum(b.w) AS sx FROM w a JOIN w b ON {_HAV} <= 500 GROUP BY a.key) g,
        (SELECT CAST(count(*) AS DOUBLE) AS n, avg(w) AS m, stddev_pop(w) AS sd FROM w) s) WHERE z >= 1.96 GROUP BY nation ORDER BY n DESC, nation LIMIT 12""",
      {"w": f"SELECT key, nation, lon, lat, {_XW} AS w FROM pts"}),
)
def hot_spot_counts(spark, sf):
    """Significant points per group, the twelve largest groups."""
    from compindex.functions.scaling import severity_weight

    rows = cut_lineage(points(spark, sf).withColumn("w", severity_weight(F.col("x"))).select("nation", "lon", "lat", "w"))
    hot = G.band_gi_star(rows, F.col("w")).where(F.col("gi_z") >= 1.96)
    counts = rows.join(hot, ["lon", "lat"]).groupBy("nation").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "nation").limit(12)


@query(
    "inverse_distance_lag",
    X.sql("pts", f"""SELECT lon, lat, round(sum(w), 8) AS w_sum, round(coalesce(sum(w * x) / sum(w), 0), 6) AS lag FROM (
      SELECT a.lon, a.lat, b.x, CASE WHEN d > 0 AND d <= 4000 THEN 1 / d END AS w FROM (SELECT DISTINCT lon, lat FROM pts) a,
      LATERAL (SELECT b.x, {_HAV} AS d FROM pts b) b) GROUP BY lon, lat"""),
)
def inverse_distance_lag(spark, sf):
    out = G.inverse_distance_lag(points(spark, sf), F.col("x"))
    return out.select("lon", "lat", r8("w_sum"), F.round("lag", 6).alias("lag"))


@query(
    "inverse_distance_moran",
    X.sql("pts", f"""SELECT (SELECT count(*) FROM pts) AS n, round((SELECT count(*) FROM pts) * sum(z * lag) / (count(*) FILTER (WHERE ws > 0) * (SELECT sum(z * z) FROM t)), 8) AS moran_i
      FROM (SELECT a.key, any_value(a.z) AS z, sum(w) AS ws, coalesce(sum(w * bz) / sum(w), 0) AS lag FROM (SELECT a.key, a.z, b.z AS bz, CASE WHEN {_HAV} > 0 AND {_HAV} <= 4000
      THEN 1 / {_HAV} END AS w FROM t a, t b) a GROUP BY a.key)""", {"t": "SELECT key, lon, lat, x - (SELECT avg(x) FROM pts) AS z FROM pts"}),
)
def inverse_distance_moran(spark, sf):
    return G.inverse_distance_moran(points(spark, sf), "x").select("n", r8("moran_i"))


_NEAREST = """SELECT key AS i, j, rn AS place FROM (SELECT a.key, b.key AS j, row_number() OVER (PARTITION BY a.key ORDER BY
   (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat), b.key) AS rn FROM pts a JOIN pts b ON a.key <> b.key) WHERE rn <= 8"""


@query("nearest_neighbours", X.sql("pts", f"SELECT i, j, place FROM ({_NEAREST})"))
def nearest_neighbours(spark, sf):
    return G.nearest(points(spark, sf), "key", "lon", "lat", 8).select("i", "j", "place")


@query(
    "nearest_neighbours_named",
    X.sql("pts", f"""SELECT a.c_name AS i, b.c_name AS j, place FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d2, jn) AS place FROM
      (SELECT n.i, n.j, n.d2, c.c_name AS jn FROM near n JOIN customer c ON c.c_custkey = n.j)) JOIN customer a ON a.c_custkey = i JOIN customer b ON b.c_custkey = j WHERE place <= 8""",
      {"near": "SELECT a.key AS i, b.key AS j, (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat) AS d2 FROM pts a JOIN pts b ON a.key <> b.key"}),
)
def nearest_neighbours_named(spark, sf):
    """The same with customer names as keys; equal distances go by name."""
    names = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    return G.nearest(points(spark, sf).join(names, "key"), "c_name", "lon", "lat", 8).select("i", "j", "place")


@query(
    "neighbour_moran",
    X.sql("pts", """SELECT k, n, round(n * s / (n * ss), 8) AS moran_i FROM (SELECT k.k, (SELECT count(*) FROM z) AS n, (SELECT sum(z * z) FROM z) AS ss,
        sum(a.z * b.z / k.k) AS s FROM nn JOIN z a ON a.key = nn.i JOIN z b ON b.key = nn.j, (VALUES (4), (6), (8)) AS k(k) WHERE nn.place <= k.k GROUP BY k.k)""",
      {"nn": _NEAREST, "z": "SELECT key, x - (SELECT avg(x) FROM pts) AS z FROM pts"}),
)
def neighbour_moran(spark, sf):
    """Global I under 4, 6 and 8 nearest neighbours; the smaller graphs are prefixes of the largest."""
    near = cut_lineage(G.nearest(points(spark, sf), "key", "lon", "lat", 8))
    units = points(spark, sf).select(F.col("key").alias("id"), F.col("x").alias("y"))
    layers = F.array(*[F.lit(k) for k in (4, 6, 8)])
    base = cut_lineage(M.centred(units, []).withColumn("k_graph", F.explode(layers)))
    edges = near.withColumn("k_graph", F.explode(layers)).where(F.col("place") <= F.col("k_graph"))
    edges = edges.select("k_graph", "i", "j", (1.0 / F.col("k_graph")).alias("w"))
    out = M.moran(M.lagged(base, edges, ["k_graph"]), ["k_graph"])
    return out.select(F.col("k_graph").alias("k"), "n", r8("moran_i"))


_BIN = "CASE " + " ".join(f"WHEN d < {edge} THEN {i}" for i, edge in enumerate(G.DISTANCE_EDGES[1:])) + " END"
_EFF = {
    "t": "SELECT p.key, p.lon, p.lat, p.x, CAST(p.key % 97 AS DOUBLE) + p.lat AS y FROM pts p",
    "z": "SELECT key, lon, lat, x - (SELECT avg(x) FROM t) AS zx, y - (SELECT avg(y) FROM t) AS zy FROM t",
    "bins": f"SELECT {_BIN} AS bin, CAST(count(*) AS DOUBLE) AS pairs, sum(px) AS cx, sum(py) AS cy FROM (SELECT {_HAV} AS d, a.zx * b.zx AS px, a.zy * b.zy AS py "
            "FROM z a JOIN z b ON a.key < b.key) GROUP BY 1",
}


@query("distance_autocovariance", X.sql("pts", "SELECT bin, pairs, round(cx, 1) AS cx, round(cy, 2) AS cy FROM bins", _EFF))
def distance_autocovariance(spark, sf):
    out = G.distance_autocovariance(_effective_points(spark, sf), "x", "y").where(F.col("pairs") > 0)
    return out.select("bin", "pairs", F.round("cx", 1).alias("cx"), F.round("cy", 2).alias("cy"))


def _effective_points(spark, sf):
    rows = points(spark, sf)
    return rows.select("key", "lon", "lat", "x", ((F.col("key") % 97).cast("double") + F.col("lat")).alias("y"))


@query(
    "effective_sample_size",
    X.sql("pts", """SELECT CAST(n AS BIGINT) AS n, round(greatest(2, least(n, CASE WHEN inv > 0 THEN 1 / inv ELSE n END)), 4) AS n_eff FROM (SELECT n, 1 / n + 2 / (n * n) * s / (vx * vy) AS inv FROM
      (SELECT sum(cx * cy / pairs) AS s FROM bins), (SELECT CAST(count(*) AS DOUBLE) AS n, var_pop(x) AS vx, var_pop(y) AS vy FROM t))""", _EFF),
)
def effective_sample_size(spark, sf):
    return G.effective_size(_effective_points(spark, sf), "x", "y").select("n", F.round("n_eff", 4).alias("n_eff"))


_TRIPLET = {
    "t": _EFF["t"],
    "r0": "SELECT key, lon, lat, x, y, x - ((SELECT regr_slope(x, lon) FROM t) * lon + (SELECT regr_intercept(x, lon) FROM t)) AS rx, "
          "y - ((SELECT regr_slope(y, lon) FROM t) * lon + (SELECT regr_intercept(y, lon) FROM t)) AS ry FROM t",
    "rk": "SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS k{c}" for c in ("x", "y", "rx", "ry")) + " FROM r0",
    "z": "SELECT key, lon, lat, rx - (SELECT avg(rx) FROM r0) AS zx, ry - (SELECT avg(ry) FROM r0) AS zy FROM r0",
    "bins": _EFF["bins"],
    "eff": "SELECT n, greatest(2, least(n, CASE WHEN inv > 0 THEN 1 / inv ELSE n END)) AS n_eff FROM (SELECT n, 1 / n + 2 / (n * n) * s / (vx * vy) AS inv FROM (SELECT sum(cx * cy / pairs) AS s FROM bins), "
           "(SELECT CAST(count(*) AS DOUBLE) AS n, var_pop(rx) AS vx, var_pop(ry) AS vy FROM r0))",
    "res": "SELECT n_eff, n_eff - 2 AS v, rho, abs(rho) * sqrt((n_eff - 2) / greatest(1e-9, 1 - rho * rho)) AS tt FROM eff, (SELECT corr(krx, kry) AS rho FROM rk)",
    # Simpson's rule over the density of Student's t from 0 to the statistic
    "simp": "SELECT sum((CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + (tt * i / 4000) * (tt * i / 4000) / v, -(v + 1) / 2)) * any_value(tt) / 4000 / 3 "
            "* exp(lgamma((any_value(v) + 1) / 2) - lgamma(any_value(v) / 2)) / sqrt(any_value(v) * pi()) AS half FROM res, (SELECT unnest(range(4001)) AS i)",
}


@query(
    "association_triplet",
    X.sql("pts", """SELECT (SELECT count(*) FROM t) AS n, (SELECT round(corr(x, y), 8) FROM t) AS zero_pearson, (SELECT round(corr(kx, ky), 8) FROM rk) AS zero_spearman, round(rho, 8) AS residual_spearman,
      round(n_eff, 4) AS n_eff, CASE WHEN n_eff > 2 THEN round(1 - 2 * half, 6) END AS p FROM res, simp""", _TRIPLET),
)
def association_triplet(spark, sf):
    """Zero-order and residual association with the effective sample size and its p."""
    rows = _effective_points(spark, sf).withColumn("g", F.col("lon"))
    rows = cut_lineage(T.residuals(T.residuals(rows, [], "x", "g", "rx"), [], "y", "g", "ry"))
    zero = T.pearson(rows, [], "x", "y").select(F.struct("n", "r")).scalar()
    zero_rho = T.spearman(rows, [], "x", "y").select("rho").scalar()
    rho = T.spearman(rows, [], "rx", "ry").select("rho").scalar()
    size = G.effective_size(rows.select("lon", "lat", "rx", "ry"), "rx", "ry")
    out = size.select(
        zero["n"].alias("n"), zero["r"].alias("zero_pearson"), zero_rho.alias("zero_spearman"), rho.alias("residual_spearman"), "n_eff"
    )
    out = T.correlation_p(out, "residual_spearman", "n_eff")
    return out.select("n", r8("zero_pearson"), r8("zero_spearman"), r8("residual_spearman"), F.round("n_eff", 4).alias("n_eff"), F.round("p", 6).alias("p"))


def family_ctes(base: str, targets: str) -> dict[str, str]:
    """The association family as CTEs over base (key, lon, lat, x, g) and targets (target, key, y)."""
    return {
        "base0": base, "targets0": targets,
        "b1": "SELECT *, x - ((SELECT regr_slope(x, g) FROM base0) * g + (SELECT regr_intercept(x, g) FROM base0)) AS rx FROM base0",
        "t": "SELECT target, key, lon, lat, x, y, rx, y - (regr_slope(y, g) OVER w * g + regr_intercept(y, g) OVER w) AS ry FROM targets0 JOIN b1 USING (key) WINDOW w AS (PARTITION BY target)",
        "r0": "SELECT * FROM t WHERE rx IS NOT NULL AND ry IS NOT NULL",
        "rk": "SELECT target, " + ", ".join(f"rank() OVER (PARTITION BY target ORDER BY {c}) + (count(*) OVER (PARTITION BY target, {c}) - 1) / 2.0 AS k{c}" for c in ("x", "y", "rx", "ry")) + " FROM r0",
        "z": "SELECT target, key, lon, lat, rx - avg(rx) OVER w AS zx, ry - avg(ry) OVER w AS zy FROM r0 WINDOW w AS (PARTITION BY target)",
        "bins": f"SELECT target, {_BIN} AS bin, CAST(count(*) AS DOUBLE) AS pairs, sum(px) AS cx, sum(py) AS cy FROM (SELECT a.target, {_HAV} AS d, a.zx * b.zx AS px, a.zy * b.zy AS py "
                "FROM z a JOIN z b ON a.target = b.target AND a.key < b.key) GROUP BY 1, 2",
        "eff": "SELECT target, n, greatest(2, least(n, CASE WHEN inv > 0 THEN 1 / inv ELSE n END)) AS n_eff FROM (SELECT target, n, 1 / n + 2 / (n * n) * s / (vx * vy) AS inv FROM (SELECT target, sum(cx * cy / pairs) AS s FROM bins GROUP BY 1) JOIN "
               "(SELECT target, CAST(count(*) AS DOUBLE) AS n, var_pop(rx) AS vx, var_pop(ry) AS vy FROM r0 GROUP BY 1) USING (target)) WHERE n >= 10",
        "res": "SELECT target, n_eff, n_eff - 2 AS v, rho, zr, zs, abs(rho) * sqrt((n_eff - 2) / greatest(1e-9, 1 - rho * rho)) AS tt FROM eff JOIN (SELECT target, corr(krx, kry) AS rho, corr(kx, ky) AS zs FROM rk GROUP BY 1) USING (target) "
               "JOIN (SELECT target, corr(x, y) AS zr FROM r0 GROUP BY 1) USING (target)",
        "simp": "SELECT target, sum((CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + (tt * i / 4000) * (tt * i / 4000) / v, -(v + 1) / 2)) * any_value(tt) / 4000 / 3 "
                "* exp(lgamma((any_value(v) + 1) / 2) - lgamma(any_value(v) / 2)) / sqrt(any_value(v) * pi()) AS half FROM res, (SELECT unnest(range(4001)) AS i) WHERE v > 0 GROUP BY target",
        "tested": "SELECT res.*, CASE WHEN v > 0 THEN greatest(0.0, 1 - 2 * half) END AS p FROM res LEFT JOIN simp USING (target)",
        "family": "SELECT t.*, least(1.0, b.q) AS q FROM tested t LEFT JOIN (SELECT target, min(p * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS q FROM (SELECT target, p, row_number() OVER (ORDER BY p, target) AS i, "
                  "count(*) OVER () AS m FROM tested WHERE p IS NOT NULL)) b USING (target)",
    }


# Targets of the family: one that follows the score, one that does not, the number of orders, and one with too few keys.
FAMILY = ("follows", "wanders", "orders", "few")
_FAMILY = family_ctes(
    "SELECT key, lon, lat, x, lon AS g FROM pts",
    "SELECT 'follows' AS target, key, x * 0.5 + (key % 7) * 400.0 AS y FROM pts WHERE key % 3 <> 1 UNION ALL SELECT 'wanders', key, CAST((key * key) % 97 AS DOUBLE) + lat FROM pts UNION ALL "
    "SELECT 'orders', o_custkey, CAST(count(*) AS DOUBLE) FROM orders GROUP BY 2 UNION ALL SELECT 'few', key, x FROM pts WHERE key < 6",
)


def family(spark, sf):
    rows = cut_lineage(points(spark, sf))
    y = lambda name, value: F.struct(F.lit(name).alias("target"), value.cast("double").alias("y"))
    key = F.col("key")
    some = F.array(
        F.when(key % 3 != 1, y("follows", F.col("x") * 0.5 + (key % 7) * 400.0)), y("wanders", ((key * key) % 97).cast("double") + F.col("lat")),
        F.when(key < 6, y("few", F.col("x"))),
    )
    targets = rows.select("key", F.inline(F.array_compact(some))).select("target", "key", "y")
    orders = X.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("y")).select(F.lit("orders").alias("target"), "key", "y")
    base = rows.select("key", "lon", "lat", F.col("x").cast("double").alias("x"), F.col("lon").alias("g"))
    return T.association_family(base, targets.unionByName(orders), list(FAMILY), G.effective_sizes)


@query(
    "association_family",
    X.sql("pts", """SELECT target, round(zr, 8) AS zero_pearson, round(zs, 8) AS zero_spearman, round(rho, 8) AS residual_spearman, round(n_eff, 4) AS n_eff, round(p, 6) AS p, round(q, 6) AS q FROM family""", _FAMILY),
)
def association_family(spark, sf):
    """Triplets of one score with several targets, all in one walk over the pairs."""
    return family(spark, sf).select(
        "target", r8("zero_pearson"), r8("zero_spearman"), r8("residual_spearman"), F.round("n_eff", 4).alias("n_eff"), F.round("p", 6).alias("p"), F.round("q", 6).alias("q")
    )


@query(
    "incremental_verdicts",
    X.sql("pts", """SELECT proximate, CASE WHEN count(q) = 0 THEN 'NOT RUN' WHEN bool_or(rho > 0 AND q < 0.05) THEN 'PASS' ELSE 'NOT DEMONSTRATED' END AS incremental
      FROM (SELECT unnest(['follows', 'wanders', 'few']) AS proximate) LEFT JOIN family ON target = proximate GROUP BY 1""", _FAMILY),
)
def incremental_verdicts(spark, sf):
    """The incremental criterion for three choices of the pre-registered target."""
    from compindex.operators.scenario import incremental_label

    found, out = cut_lineage(family(spark, sf)), None
    for name in ("follows", "wanders", "few"):
        row = T.incremental(found, [name]).select(F.lit(name).alias("proximate"), incremental_label(F.col("incremental")).alias("incremental"))
        out = row if out is None else out.unionByName(row)
    return out


_KDE = {
    "w": f"SELECT lon, lat, {_XW} AS w FROM pts",
    "s": "SELECT sum(w) AS sw, sum(w * w) AS ww, sum(w * lon) / sum(w) AS mx, sum(w * lat) / sum(w) AS my FROM w",
    "c": "SELECT any_value(sw) AS sw, sum(w * (lon - mx) * (lon - mx)) / any_value(sw) / (1 - any_value(ww) / (any_value(sw) * any_value(sw))) * 0.0324 AS a, "
         "sum(w * (lon - mx) * (lat - my)) / any_value(sw) / (1 - any_value(ww) / (any_value(sw) * any_value(sw))) * 0.0324 AS b, "
         "sum(w * (lat - my) * (lat - my)) / any_value(sw) / (1 - any_value(ww) / (any_value(sw) * any_value(sw))) * 0.0324 AS c FROM w, s",
    "k": "SELECT c / (a * c - b * b) AS ia, -b / (a * c - b * b) AS ib, a / (a * c - b * b) AS ic, 1 / (2 * pi() * sqrt(a * c - b * b) * sw) AS norm FROM c",
}
_DENS = "any_value(norm) * sum(w * exp(-0.5 * (ia * (g.lon - w.lon) * (g.lon - w.lon) + 2 * ib * (g.lon - w.lon) * (g.lat - w.lat) + ic * (g.lat - w.lat) * (g.lat - w.lat))))"


@query(
    "kde_grid",
    X.sql("pts", """SELECT cell, round(share, 6) AS share FROM (SELECT cell, (d - (SELECT min(d) FROM dens)) / ((SELECT max(d) - min(d) FROM dens) + 1e-12) AS share FROM dens) WHERE share > 0.06""",
      {**_KDE, "g": "SELECT CAST(r * 144 + q AS INTEGER) AS cell, CAST(-180 AS DOUBLE) + q * (CAST(360 AS DOUBLE) / 143) AS lon, CAST(-58 AS DOUBLE) + r * (CAST(140 AS DOUBLE) / 69) AS lat "
                    "FROM (SELECT unnest(range(144)) AS q), (SELECT unnest(range(70)) AS r)",
       "dens": f"SELECT g.cell, {_DENS} AS d FROM g, w, k GROUP BY g.cell"}),
)
def kde_grid(spark, sf):
    from compindex.functions.scaling import severity_weight

    rows = cut_lineage(points(spark, sf).select("lon", "lat", severity_weight(F.col("x")).alias("w")))
    dens = cut_lineage(G.kde_grid(rows, "w"))
    out = N.trimmed_surface(dens, "density", "share")
    return out.select("cell", F.round("share", 6).alias("share"))


@query(
    "kde_at_points",
    X.sql("pts", f"SELECT lon, lat, round(d * 1000000, 4) AS density_ppm FROM (SELECT g.lon, g.lat, {_DENS} AS d FROM (SELECT DISTINCT lon, lat FROM pts) g, w, k GROUP BY g.lon, g.lat)", _KDE),
)
def kde_at_points(spark, sf):
    from compindex.functions.scaling import severity_weight

    rows = points(spark, sf).select("lon", "lat", severity_weight(F.col("x")).alias("w"))
    out = G.kde_at_points(rows, "w")
    return out.select("lon", "lat", F.round(F.col("density") * 1000000, 4).alias("density_ppm"))
