"""The spatial operators on a layer of units that grows with the customers: a bent lattice whose cells are slanted or
concave, every third with a hole, and every eleventh a second part of another unit."""

from __future__ import annotations

from pyspark.sql import functions as F

from compindex.operators import association as M
from compindex.operators import spatial as G
from compindex.operators.within import points_within
from compindex.session import cut_lineage
from compindex.workload import fixtures as X
from compindex.workload import spatial as S
from compindex.workload.core import r8
from compindex.workload.registry import query

# One unit in so many customers, extent and bend of the lattice.
PER_UNIT = 10
WIDE, TALL = 360.0, 160.0
BENDS = ((7919, 104729, 101, 0.6 / 101), (15485863, 7919, 97, 0.6 / 97))
SIDES = ((0, 0), (1, 0), (1, 1), (0, 1))
HOLE = ((-0.1, -0.1), (0.1, -0.1), (0.0, 0.1))


def _num(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def _corner_sql(di: int, dj: int) -> tuple[str, str]:
    out = []
    for (a, b, m, step), span, at, d in zip(BENDS, (WIDE, TALL), "ij", (di, dj)):
        bend = f"CAST(((i + {di}) * {a} + (j + {dj}) * {b}) % {m} - {m // 2} AS DOUBLE) * {_num(step)} * ({_num(span)} / g)"
        out.append(f"(CAST({at} + {d} AS DOUBLE) * ({_num(span)} / g) - {_num(span / 2)} + {bend})")
    return out[0], out[1]


def _corner(g, i, j):
    out = []
    for (a, b, m, step), span, at in zip(BENDS, (WIDE, TALL), (i, j)):
        bend = ((i * a + j * b) % m - m // 2).cast("double") * F.lit(step) * (F.lit(span) / g)
        out.append(at.cast("double") * (F.lit(span) / g) - F.lit(span / 2) + bend)
    return F.struct(out[0].alias("x"), out[1].alias("y"))


def units(spark, sf):
    """(id, rings) of every unit."""
    customers = X.table(spark, sf, "customer")
    side = customers.agg(F.floor(F.sqrt(F.count(F.lit(1)) / PER_UNIT)).cast("long")).scalar()
    cells = customers.where(F.col("c_custkey") % PER_UNIT == 0).select(F.expr(f"CAST(c_custkey DIV {PER_UNIT} AS BIGINT)").alias("k"), side.alias("g"))
    cells = cells.where(F.col("k") < F.col("g") * F.col("g")).withColumns({"i": F.col("k") % F.col("g"), "j": F.expr("k DIV g")})
    corners = [_corner(F.col("g"), F.col("i") + di, F.col("j") + dj) for di, dj in SIDES]
    middle = {a: (((corners[0][a] + corners[1][a]) + corners[2][a]) + corners[3][a]) * 0.25 for a in "xy"}
    hole = [F.struct((middle["x"] + F.lit(WIDE * u) / F.col("g")).alias("x"), (middle["y"] + F.lit(TALL * v) / F.col("g")).alias("y")) for u, v in HOLE]
    outer, inner = F.array(*corners, corners[0]), F.array(*hole, hole[0])
    rings = F.when(F.col("k") % 3 == 0, F.array(outer, inner)).otherwise(F.array(outer))
    area = F.col("g") * F.col("g")
    owner = F.when(F.col("k") % 11 == 5, (F.col("k") + 2 * F.col("g") + 3) % area).otherwise(F.col("k"))
    return cells.select(owner.alias("id"), "k", rings.alias("rings")).groupBy("id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "rings"))), lambda c: c["rings"])).alias("rings"))


_MX, _MY = (f"((({'x0 + x1'.replace('x', a)}) + {a}2) + {a}3) * {_num(0.25)}" for a in "xy")
_HOLE = [(f"mx + {_num(WIDE * u)} / g", f"my + {_num(TALL * v)} / g") for u, v in HOLE]
_LAYER = {
    "lattice": f"SELECT CAST(floor(sqrt(count(*) / {PER_UNIT})) AS BIGINT) AS g FROM customer",
    "place": f"SELECT CAST(c_custkey // {PER_UNIT} AS BIGINT) AS k, g, k % g AS i, k // g AS j FROM customer, lattice WHERE c_custkey % {PER_UNIT} = 0 AND k < g * g",
    "quad": "SELECT CASE WHEN k % 11 = 5 THEN (k + 2 * g + 3) % (g * g) ELSE k END AS id, k, g, "
            + ", ".join(f"{v} AS {a}{n}" for n, d in enumerate(SIDES) for a, v in zip("xy", _corner_sql(*d))) + " FROM place",
    "mid": f"SELECT *, {_MX} AS mx, {_MY} AS my FROM quad",
    "edge": " UNION ALL ".join(
        [f"SELECT id, x{n} AS x1, y{n} AS y1, x{(n + 1) % 4} AS x2, y{(n + 1) % 4} AS y2 FROM mid" for n in range(4)]
        + [f"SELECT id, {_HOLE[n][0]}, {_HOLE[n][1]}, {_HOLE[(n + 1) % 3][0]}, {_HOLE[(n + 1) % 3][1]} FROM mid WHERE k % 3 = 0" for n in range(3)]
    ),
    "corner": "SELECT DISTINCT id, x1 AS x, y1 AS y FROM edge",
    "inside": "SELECT p.key, p.x AS v, e.id FROM pts p, edge e WHERE (y1 > lat) <> (y2 > lat) AND ((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1) > 0) = (y2 > y1) "
              "AND (x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1) <> 0 GROUP BY ALL HAVING count(*) % 2 = 1",
    "adj": S._QUEEN["adj"],
    "unit": "SELECT id, avg(v) AS y FROM (SELECT DISTINCT id FROM edge) LEFT JOIN inside USING (id) GROUP BY id",
    "zed": S._QUEEN["zed"], "lag": S._QUEEN["lag"],
}


def _sql(body, *more):
    return X.sql("pts", body, {**_LAYER, **{k: v for part in more for k, v in part.items() if k not in {**S._QUEEN}}})


def matched(spark, sf):
    return points_within(S.points(spark, sf), units(spark, sf))


def unit_values(spark, sf):
    """Mean balance of the customers inside every unit; null where there are none."""
    means = matched(spark, sf).groupBy(F.col("unit").alias("id")).agg(F.avg("x").alias("y"))
    return units(spark, sf).select("id").join(means, "id", "left")


@query("unit_members", _sql("SELECT key, id AS unit FROM inside"))
def unit_members(spark, sf):
    return matched(spark, sf).select("key", "unit")


@query("unit_events", _sql("SELECT id AS unit, count(*) AS events, count(DISTINCT key % 7) AS years FROM inside GROUP BY 1"))
def unit_events(spark, sf):
    return G.unit_events(matched(spark, sf).withColumn("year", F.col("key") % 7), "year")


@query("unit_contiguity", _sql("SELECT i, j, round(CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY i), 8) AS w FROM adj"))
def unit_contiguity(spark, sf):
    return G.queen_edges(units(spark, sf)).select("i", "j", r8("w"))


def layer(spark, sf):
    return cut_lineage(unit_values(spark, sf)), cut_lineage(G.queen_edges(units(spark, sf)))


# units without customers have no value and are nobody's neighbours
_KEPT = {"deg": "SELECT adj.i, count(*) AS k FROM adj JOIN zed a ON a.id = adj.i JOIN zed b ON b.id = adj.j GROUP BY adj.i"}


@query("unit_moran_permutation", _sql(S._MORAN_PERM_SQL, S._PERM, S._SIMS, _KEPT))
def unit_moran_permutation(spark, sf):
    out = M.moran_permutations(*layer(spark, sf), S.PERMS, S.SEED)
    return out.select("n", r8("moran_i"), F.round("z_sim", 6).alias("z_sim"), r8("p_sim"))


# a unit that touches all others has no spread to be measured by: no z_sim, and a Gi* of 0
_SPREAD = {"pv": S._LOCAL_P["pv"].replace("/ stddev_pop((n - 1) / ss * z * slag) AS zs", "/ nullif(stddev_pop((n - 1) / ss * z * slag), 0) AS zs")}
_GI_SPREAD = S._GI_SQL.replace(
    "round((z + lag * k) / (k + 1) / (sqrt(ss / n) * sqrt((n / (k + 1) - 1) / (n - 1))), 8)",
    "round(coalesce((z + lag * k) / (k + 1) / nullif(sqrt(ss / n) * sqrt((n / (k + 1) - 1) / (n - 1)), 0), 0), 8)",
).replace("WHEN (z + lag * k) > 0 THEN 'Hot-Spot'", "WHEN (z + lag * k) > 0 AND n > k + 1 THEN 'Hot-Spot'")


@query("unit_local_moran", _sql(S._LOCAL_MORAN_SQL, S._LOCAL, {**S._LOCAL_P, **_SPREAD}))
def unit_local_moran(spark, sf):
    values, edges = layer(spark, sf)
    out = M.local_moran(values, edges, [], S.PERMS, S.SEED)
    return out.select("id", r8("local_i"), "quadrant", F.round("z_sim", 6).alias("z_sim"), r8("p_raw"), r8("p_fdr"), "cluster_raw", "cluster_fdr")


@query("unit_gi_star", _sql(_GI_SPREAD, S._LOCAL, S._GI_P))
def unit_gi_star(spark, sf):
    values, edges = layer(spark, sf)
    return M.local_gi_star(values, edges, [], S.PERMS, S.SEED).select("id", r8("gistar_z"), r8("gistar_p"), r8("gistar_p_fdr"), "gistar_cluster")
