"""Containment, contiguity, distance bands, nearest neighbours and hot spots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compindex.functions import geo as G
from compindex.operators import blocks as K
from compindex.operators import celltree as CT
from compindex.operators import order as O
from compindex.operators import ranking as R
from compindex.operators.within import points_within
from compindex.session import compute_tasks, cut_lineage


# --- polygons --------------------------------------------------------------------------


def unit_events(matched: DataFrame, year: str) -> DataFrame:
    """Events and distinct years per polygon."""
    return matched.groupBy("unit").agg(F.count(F.lit(1)).alias("events"), F.count_distinct(year).alias("years"))


def queen_edges(polygons: DataFrame) -> DataFrame:
    """Directed pairs of polygons that share at least one vertex, with row-standardised weights."""
    corners = polygons.select("id", F.explode(F.flatten("rings")).alias("p")).select(
        "id", F.col("p.x").alias("x"), F.col("p.y").alias("y")
    ).distinct()
    other = corners.withColumnRenamed("id", "j")
    touching = corners.withColumnRenamed("id", "i").join(other, ["x", "y"]).where(F.col("i") != F.col("j"))
    return row_standardised(touching.select("i", "j").distinct())


def row_standardised(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Weights that sum to 1 per unit; units without neighbours have no rows."""
    raw = edges.withColumn("w", F.lit(1.0) if weight is None else F.col(weight))
    sums = raw.groupBy("i").agg(F.sum("w").alias("_sum"))
    return raw.join(sums, "i").select("i", "j", (F.col("w") / F.col("_sum")).alias("w"))


# --- bands -----------------------------------------------------------------------------


def band_gi_star(points: DataFrame, value: Column, band_km: float = 500.0) -> DataFrame:
    """Gi* per location with binary band weights, the point itself included."""
    rows = cut_lineage(points.where(value.isNotNull()).select("lon", "lat", value.cast("double").alias("_x")))
    locs = K.locations(rows, "lon", "lat", {"sx": F.col("_x")})

    sums = CT.band_totals(locs, ["w", "sx"], band_km).withColumnsRenamed({"w": "n_near", "sx": "sum_near"})
    overall = rows.agg(
        F.struct(
            F.count("_x").cast("double").alias("n"), F.avg("_x").alias("mean"), F.avg(F.col("_x") * F.col("_x")).alias("mean_sq")
        )
    ).scalar()
    n, mean = overall["n"], overall["mean"]
    spread = F.sqrt(F.greatest(F.lit(0.0), overall["mean_sq"] - mean * mean))
    near = F.col("n_near")
    scale = spread * F.sqrt(F.greatest(F.lit(0.0), F.try_divide(n * near - near * near, n - 1.0)))
    z = F.when(scale > 0, F.try_divide(F.col("sum_near") - mean * near, scale)).otherwise(0.0)
    return sums.select("lon", "lat", near.alias("n_near"), z.alias("gi_z"))


def inverse_distance_lag(points: DataFrame, value: Column, band_km: float = 4000.0) -> DataFrame:
    """Per location: weight sum and row-standardised lag of inverse-distance weights in a band.

    Points at the same place have distance 0 and no weight on each other; a location without
    any weight keeps a lag of 0.
    """
    rows = points.where(value.isNotNull()).select("lon", "lat", value.cast("double").alias("_x"))
    locs = K.locations(rows, "lon", "lat", {"sx": F.col("_x")})

    def kernel(probe: dict, source: dict) -> dict:
        i, j, far = K.near_pairs(probe["lon"], probe["lat"], source["lon"], source["lat"], band_km)
        i, j, far = i[far > 0.0], j[far > 0.0], far[far > 0.0]
        add = lambda v: np.bincount(i, v, len(probe["lon"]))
        return {"n_near": add(source["w"][j]), "w_sum": add(source["w"][j] / far), "w_x": add(source["sx"][j] / far)}

    sums = K.grid_sums(locs, ["w", "sx"], ["n_near", "w_sum", "w_x"], kernel)
    return sums.withColumn("lag", F.when(F.col("w_sum") > 0, F.try_divide(F.col("w_x"), F.col("w_sum"))).otherwise(0.0))


def inverse_distance_moran(points: DataFrame, value: str, band_km: float = 4000.0) -> DataFrame:
    """Moran's I under row-standardised inverse-distance weights."""
    points = cut_lineage(points.where(F.col(value).isNotNull()).select("lon", "lat", F.col(value).alias("_y")))
    mean = points.agg(F.avg("_y")).scalar()
    centred = cut_lineage(points.select("lon", "lat", (F.col("_y") - mean).alias("z")))
    lag = inverse_distance_lag(centred, F.col("z"), band_km)
    sums = centred.groupBy("lon", "lat").agg(
        F.count(F.lit(1)).alias("n"), F.sum("z").alias("z"), F.sum(F.col("z") * F.col("z")).alias("zz")
    )
    joined = sums.join(lag, ["lon", "lat"])
    return joined.agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("w_sum") > 0, F.col("n")).otherwise(0)).alias("s0"),
        F.sum(F.col("z") * F.col("lag")).alias("_num"), F.sum("zz").alias("_den"),
    ).select("n", F.try_divide(F.col("n") * F.col("_num"), F.col("s0") * F.col("_den")).alias("moran_i"))


# Distance bin edges in km.
DISTANCE_EDGES = (0, 500, 1000, 1500, 2000, 3000, 4000, 6000, 8000, 12000, 20000, 40000)


def distance_autocovariance(points: DataFrame, x: str, y: str) -> DataFrame:
    """Per distance bin: number of unordered pairs and summed products of two centred series.

    Pairs at one place follow from the place's sums; pairs of places from sums over whole cells, where the
    cells' distance settles the bin.
    """
    points = cut_lineage(points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("lon", "lat", x, y))
    means = points.agg(F.struct(F.avg(x).alias("x"), F.avg(y).alias("y"))).scalar()
    zx, zy = F.col(x) - means["x"], F.col(y) - means["y"]
    centred = points.select("lon", "lat", zx.alias("zx"), zy.alias("zy"))
    squares = {"qx": F.col("zx") * F.col("zx"), "qy": F.col("zy") * F.col("zy")}
    locs = cut_lineage(K.locations(centred, "lon", "lat", {"zx": F.col("zx"), "zy": F.col("zy"), **squares}))
    across = CT.distance_bins(locs, "w", ["zx", "zy"], DISTANCE_EDGES).withColumnsRenamed({"zx": "cx", "zy": "cy"})
    within = locs.agg(
        F.lit(0).alias("bin"), (F.sum(F.col("w") * (F.col("w") - 1)) / 2).alias("pairs"),
        (F.sum(F.col("zx") * F.col("zx") - F.col("qx")) / 2).alias("cx"),
        (F.sum(F.col("zy") * F.col("zy") - F.col("qy")) / 2).alias("cy"),
    )
    return across.unionByName(within).groupBy("bin").agg(
        F.sum("pairs").alias("pairs"), F.sum("cx").alias("cx"), F.sum("cy").alias("cy")
    )


def effective_size(points: DataFrame, x: str, y: str) -> DataFrame:
    """Effective sample size of a correlation between two spatially dependent series."""
    usable = cut_lineage(points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("lon", "lat", x, y))
    bins = distance_autocovariance(usable, x, y).where(F.col("pairs") > 0)
    spread = usable.agg(
        F.struct(F.count(F.lit(1)).cast("double").alias("n"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    ).scalar()
    total = bins.agg(F.sum(F.col("cx") * F.col("cy") / F.col("pairs")).alias("_s"))
    n = spread["n"]
    inverse = 1.0 / n + 2.0 / (n * n) * F.try_divide(F.col("_s"), spread["vx"] * spread["vy"])
    neff = F.when(inverse > 0, F.try_divide(F.lit(1.0), inverse)).otherwise(n)
    return total.select(n.cast("long").alias("n"), F.greatest(F.lit(2.0), F.least(n, neff)).alias("n_eff"))


def effective_sizes(rows: DataFrame, targets: list[str], x: str, y: str) -> DataFrame:
    """(target, n, n_eff) for several targets in one walk over the pairs of cells.

    ``rows`` is (target, lon, lat, x, y); every target has its own points, which are columns of sums beside each other.
    """
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull() & F.col("target").isin(*targets))
    rows = cut_lineage(rows.select("target", "lon", "lat", F.col(x).alias("x"), F.col(y).alias("y")))
    spread = cut_lineage(rows.groupBy("target").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy")
    ))
    centred = O.attach(rows, spread, ["target"]).withColumns({"zx": F.col("x") - F.col("mx"), "zy": F.col("y") - F.col("my")})
    parts = {"w": F.lit(1.0), "zx": F.col("zx"), "zy": F.col("zy"), "qx": F.col("zx") * F.col("zx"), "qy": F.col("zy") * F.col("zy")}
    own = lambda k, c: F.sum(F.when(F.col("target") == targets[k], c).otherwise(0.0))
    locs = cut_lineage(centred.groupBy("lon", "lat").agg(*[own(k, c).alias(f"{p}_{k}") for k in range(len(targets)) for p, c in parts.items()]))
    names = [f"{p}_{k}" for k in range(len(targets)) for p in ("w", "zx", "zy")]
    across = CT.distance_bins(locs.select("lon", "lat", *names), names[0], names[1:], DISTANCE_EDGES).withColumnRenamed("pairs", names[0])
    inside = [((F.sum(F.col(f"w_{k}") * (F.col(f"w_{k}") - 1))) / 2).alias(f"w_{k}") for k in range(len(targets))]
    inside += [(F.sum(F.col(f"z{a}_{k}") * F.col(f"z{a}_{k}") - F.col(f"q{a}_{k}")) / 2).alias(f"z{a}_{k}") for k in range(len(targets)) for a in "xy"]
    bins = across.unionByName(locs.agg(F.lit(0).alias("bin"), *inside)).groupBy("bin").agg(*[F.sum(n).alias(n) for n in names])
    named = [F.struct(F.lit(t).alias("target"), F.col(f"w_{k}").alias("pairs"), F.col(f"zx_{k}").alias("cx"), F.col(f"zy_{k}").alias("cy")) for k, t in enumerate(targets)]
    total = bins.select(F.inline(F.array(*named))).where(F.col("pairs") > 0.5).groupBy("target").agg(F.sum(F.col("cx") * F.col("cy") / F.col("pairs")).alias("_s"))
    n = F.col("n")
    inverse = 1.0 / n + 2.0 / (n * n) * F.try_divide(F.col("_s"), F.col("vx") * F.col("vy"))
    size = F.when(inverse > 0, F.try_divide(F.lit(1.0), inverse)).otherwise(n)
    return spread.join(total, "target", "left").select("target", n.cast("long").alias("n"), F.greatest(F.lit(2.0), F.least(n, size)).alias("n_eff"))


# --- nearest neighbours ----------------------------------------------------------------


def nearest(points: DataFrame, key: str, x: str, y: str, k: int) -> DataFrame:
    """Exact ``k`` nearest neighbours on planar coordinates, ties by key.

    Each round searches the adjacent cells of a grid. A location is settled once its
    (k+1)-th candidate is no further than one cell side; the rest go on with doubled cells.
    At one place only the first k+1 keys can be neighbours of anyone, so copies do not pile up.
    """
    points = cut_lineage(points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, x, y))
    source = cut_lineage(R.top_by_group(points, [x, y], [F.col(key)], k + 1).drop("place"))
    box = points.agg(
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count(F.lit(1)).alias("n")
    ).first()
    extent = max(box["x1"] - box["x0"], box["y1"] - box["y0"], 1e-9)
    side = min(extent, extent * math.sqrt(max(2.0 * (k + 1), K.CELL_ROWS / 2) / max(box["n"], 1)))
    todo = points.select(x, y).distinct()
    settled = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for row in batch.to_dict("records"):
                px, py = np.asarray(row[f"p_{x}"]), np.asarray(row[f"p_{y}"])
                keys = np.asarray(row[f"s_{key}"])
                by_key = np.argsort(keys, kind="stable")
                sx, sy, keys = np.asarray(row[f"s_{x}"])[by_key], np.asarray(row[f"s_{y}"])[by_key], keys[by_key]
                d2 = (px[:, None] - sx[None, :]) ** 2 + (py[:, None] - sy[None, :]) ** 2
                best = np.argsort(d2, axis=1, kind="stable")[:, : k + 1]
                width = best.shape[1]
                parts.append(
                    pd.DataFrame(
                        {
                            x: np.repeat(px, width), y: np.repeat(py, width), "j": keys[best].ravel(),
                            "d2": np.take_along_axis(d2, best, axis=1).ravel(),
                        }
                    )
                )
            if parts:
                yield pd.concat(parts)

    while True:
        cells = G.plane_cells(F.col(x), F.col(y), side)
        probe_blocks = blocked_xy(todo, cells, [x, y], [x, y])
        source_blocks = blocked_xy(source, cells, [x, y, key], [x, y, key])
        pairs = K.block_pairs(probe_blocks, source_blocks, 2, True).drop(f"p_{key}")
        found = pairs.select(f"p_{x}", f"p_{y}", f"s_{x}", f"s_{y}", f"s_{key}").mapInPandas(
            run, f"{x} double, {y} double, j {dict(points.dtypes)[key]}, d2 double"
        )
        best = R.top_by_group(found, [x, y], [F.col("d2"), F.col("j")], k + 1)
        last = side >= extent
        if last:
            settled.append(cut_lineage(best))
            break
        best = cut_lineage(best)
        done = best.where((F.col("place") == k + 1) & (F.col("d2") <= side * side)).select(x, y)
        settled.append(best.join(done, [x, y], "left_semi"))
        todo = cut_lineage(todo.join(done, [x, y], "left_anti"))
        if todo.isEmpty():
            break
        side = min(side * 2.0, extent)
    candidates = settled[0]
    for more in settled[1:]:
        candidates = candidates.unionByName(more)
    near = points.select(F.col(key).alias("i"), x, y).join(candidates, [x, y]).where(F.col("i") != F.col("j"))
    return R.top_by_group(near.select("i", "j", "d2"), ["i"], [F.col("d2"), F.col("j")], k)


def blocked_xy(df: DataFrame, cells: list[Column], columns: list[str], by: list[str]) -> DataFrame:
    return cut_lineage(K.blocked(df, cells, columns, by))


# --- density ---------------------------------------------------------------------------

# Bandwidth factor and the grid of the density surface.
KDE_FACTOR = 0.18
GRID = {"lon": (-180.0, 180.0, 144), "lat": (-58.0, 82.0, 70)}


def kde_shape(points: DataFrame, weight: str, factor: float = KDE_FACTOR) -> Column:
    """Weighted covariance times the squared factor, inverted, as a one-row subquery."""
    w, x, y = F.col(weight), F.col("lon"), F.col("lat")
    sums = points.agg(
        F.sum(w).alias("w"), F.sum(w * w).alias("ww"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"),
        F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"), F.sum(w * x * y).alias("xy"),
    )
    mean_x, mean_y = F.col("x") / F.col("w"), F.col("y") / F.col("w")
    unbias = 1.0 - F.col("ww") / (F.col("w") * F.col("w"))
    cov = lambda s, a, b: (F.col(s) / F.col("w") - a * b) / unbias * F.lit(factor * factor)
    covs = sums.select(
        "w", cov("xx", mean_x, mean_x).alias("a"), cov("xy", mean_x, mean_y).alias("b"), cov("yy", mean_y, mean_y).alias("c")
    )
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    return covs.select(
        F.struct(
            (F.col("c") / det).alias("ia"), (-F.col("b") / det).alias("ib"), (F.col("a") / det).alias("ic"),
            (1.0 / (F.lit(2.0 * math.pi) * F.sqrt(det) * F.col("w"))).alias("norm"),
        )
    ).scalar()


def _kernel_rows(px, py, sx, sy, sw, ia, ib, ic):
    dx, dy = px[:, None] - sx[None, :], py[:, None] - sy[None, :]
    return np.exp(-0.5 * (ia * dx * dx + 2.0 * ib * dx * dy + ic * dy * dy)) @ sw


def kde_grid(points: DataFrame, weight: str) -> DataFrame:
    """Gaussian density on the grid. Every task sums its own points over the whole grid, so
    the shuffle carries one grid per task, whatever the number of points."""
    shape = kde_shape(points, weight)
    locs = points.groupBy("lon", "lat").agg(F.sum(weight).alias("sw"))
    rows = locs.select("lon", "lat", "sw", *[shape[n].alias(n) for n in ("ia", "ib", "ic", "norm")])
    rows = rows.repartition(compute_tasks(points), "lon", "lat")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gx, gy = np.linspace(*GRID["lon"]), np.linspace(*GRID["lat"])
        xs, ys = np.tile(gx, len(gy)), np.repeat(gy, len(gx))
        total, norm = np.zeros(len(xs)), 0.0
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.iloc[start:start + 512]
                first = part.iloc[0]
                norm = first["norm"]
                total += _kernel_rows(
                    xs, ys, part["lon"].to_numpy(), part["lat"].to_numpy(), part["sw"].to_numpy(),
                    first["ia"], first["ib"], first["ic"],
                )
        yield pd.DataFrame({"cell": np.arange(len(xs)), "lon": xs, "lat": ys, "density": total * norm})

    parts = rows.mapInPandas(run, "cell int, lon double, lat double, density double")
    return parts.groupBy("cell", "lon", "lat").agg(F.sum("density").alias("density"))


def kde_at_points(points: DataFrame, weight: str) -> DataFrame:
    """Gaussian density at the distinct locations themselves."""
    points = cut_lineage(points.select("lon", "lat", weight))
    shape = kde_shape(points, weight)
    locs = points.groupBy("lon", "lat").agg(F.sum(weight).alias("sw"))
    locs = cut_lineage(locs.select("lon", "lat", "sw", *[shape[n].alias(n) for n in ("ia", "ib", "ic", "norm")]))

    def kernel(probe: dict, source: dict) -> dict:
        ia, ib, ic, norm = (float(source[n][0]) for n in ("ia", "ib", "ic", "norm"))
        parts = [
            _kernel_rows(probe["lon"][a:a + 512], probe["lat"][a:a + 512], source["lon"], source["lat"], source["sw"], ia, ib, ic)
            for a in range(0, len(probe["lon"]), 512)
        ]
        return {"density": np.concatenate(parts) * norm}

    carried = ["sw", "ia", "ib", "ic", "norm"]
    return K.grid_sums(locs, carried, ["density"], kernel)
