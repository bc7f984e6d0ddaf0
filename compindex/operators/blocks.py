"""Sums over pairs of points without one row per pair.

Points collapse to distinct locations. Where every location counts for every other (``grid_sums``), locations are dealt
to a square grid of tasks: each goes to one row and one column of it, so with t tasks every location moves about 2 * sqrt(t) times,
and the pairs are compared inside the tasks, block against block. Where only neighbours count (``block_pairs``), locations fall
into cells, and a cell is split by hash into blocks of bounded size, of which those of adjacent cells are joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compindex.functions import geo as G
from compindex.operators.order import attach
from compindex.session import compute_tasks, cut_lineage

BLOCK_ROWS = 2048
CELL_ROWS = 256
GRID_ROWS, GRID_BLOCK = 65_536, 1_024


def locations(points: DataFrame, x: str, y: str, sums: dict[str, Column]) -> DataFrame:
    """Distinct locations with their number of points and summed attributes."""
    return points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(
        F.count(F.lit(1)).cast("double").alias("w"), *[F.sum(c).alias(n) for n, c in sums.items()]
    )


def blocked(df: DataFrame, cells: list[Column], columns: list[str], by: list[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per (cell, block) with parallel arrays; no array is longer than about ``rows``."""
    names = [f"c{i}" for i in range(len(cells))]
    placed = df.select(*columns, *[c.alias(n) for c, n in zip(cells, names)])
    sizes = placed.groupBy(*names).agg(F.count(F.lit(1)).alias("_size"))
    slices = F.ceil(F.col("_size") / rows)
    # a crowded cell must not become one join key: the size table goes to the points
    sliced = attach(placed, sizes, names).withColumn("b", F.pmod(F.xxhash64(*by), slices).cast("int"))
    return sliced.groupBy(*names, "b").agg(*[F.collect_list(c).alias(c) for c in columns])


def block_pairs(probe: DataFrame, source: DataFrame, dims: int, adjacent: bool) -> DataFrame:
    """Blocks of the same or of adjacent cells side by side; columns get ``p_`` and ``s_``.

    The pairing runs on block names alone. The arrays join afterwards by block, so the many
    pairs of a crowded cell are spread over tasks.
    """
    names = [f"c{i}" for i in range(dims)]
    p_ids = [F.col(n).alias(f"p_{n}") for n in (*names, "b")]
    s_ids = [F.col(n).alias(f"s_{n}") for n in (*names, "b")]
    left = probe.select(*p_ids)
    if adjacent:
        near = F.explode(G.neighbour_cells([F.col(f"p_{n}") for n in names]))
        left = left.withColumn("_near", near)
        left = left.select("*", *[F.col("_near")[i].alias(f"s_{n}") for i, n in enumerate(names)]).drop("_near")
    else:
        left = left.select("*", *[F.col(f"p_{n}").alias(f"s_{n}") for n in names])
    pairs = left.join(source.select(*s_ids), [f"s_{n}" for n in names])
    renamed_p = probe.select(*[F.col(c).alias(f"p_{c}") for c in probe.columns])
    renamed_s = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns])
    full = pairs.join(renamed_p, [f"p_{n}" for n in (*names, "b")])
    # a stated number of partitions: the rows are few but each is a block comparison
    keys = [f"s_{n}" for n in (*names, "b")]
    return full.repartition(compute_tasks(probe), *keys).join(renamed_s, keys)


def haversine_matrix(lon1, lat1, lon2, lat2):
    a, b = np.radians(lat1)[:, None], np.radians(lat2)[None, :]
    half_lat = np.sin(np.radians(lat2[None, :] - lat1[:, None]) / 2.0)
    half_lon = np.sin(np.radians(lon2[None, :] - lon1[:, None]) / 2.0)
    return 2.0 * G.EARTH_KM * np.arcsin(np.sqrt(np.clip(half_lat**2 + np.cos(a) * np.cos(b) * half_lon**2, 0.0, 1.0)))


def _unit_vectors(lon, lat):
    a, b = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], axis=1)


def near_pairs(lon1, lat1, lon2, lat2, band_km: float):
    """Index pairs within a great-circle band and their distances.

    Dot products rule out the far pairs; the distance itself decides about the rest.
    """
    close = _unit_vectors(lon1, lat1) @ _unit_vectors(lon2, lat2).T >= math.cos(min(band_km / G.EARTH_KM, math.pi)) - 1e-9
    i, j = np.nonzero(close)
    half_lat, half_lon = np.sin(np.radians(lat2[j] - lat1[i]) / 2.0), np.sin(np.radians(lon2[j] - lon1[i]) / 2.0)
    h = half_lat**2 + np.cos(np.radians(lat1[i])) * np.cos(np.radians(lat2[j])) * half_lon**2
    far = 2.0 * G.EARTH_KM * np.arcsin(np.sqrt(np.clip(h, 0.0, 1.0)))
    keep = far <= band_km
    return i[keep], j[keep], far[keep]


def grid_sums(locs: DataFrame, carried: list[str], outputs: list[str], kernel: Callable[[dict, dict], dict]) -> DataFrame:
    """Per location (lon, lat): the sums of ``kernel(probe arrays, source arrays)`` over all locations, in a square grid of tasks.

    A task holds at most about ``GRID_ROWS`` locations of either side and compares ``GRID_BLOCK`` of them at once.
    """
    locs = cut_lineage(locs.select("lon", "lat", *carried))
    side = max(math.ceil(math.sqrt(compute_tasks(locs))), math.ceil(locs.count() / GRID_ROWS))
    place = F.pmod(F.xxhash64("lon", "lat"), F.lit(side)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    dealt = lambda own, other, is_probe: locs.withColumn(own, place).withColumn(other, every).withColumn("is_probe", F.lit(is_probe))
    both = dealt("row", "col", True).unionByName(dealt("col", "row", False)).repartition(side * side, "row", "col")
    columns = ["lon", "lat", *carried]

    def parts(frame: pd.DataFrame) -> list[dict]:
        return [{c: frame[c].to_numpy()[at : at + GRID_BLOCK] for c in columns} for at in range(0, len(frame), GRID_BLOCK)]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        probe, source = rows[rows["is_probe"]], rows[~rows["is_probe"]]
        if probe.empty:
            return pd.DataFrame({c: [] for c in ("lon", "lat", *outputs)}, dtype=float)
        sources, found = parts(source), []
        for block in parts(probe):
            total = {o: np.zeros(len(block["lon"])) for o in outputs}
            for other in sources:
                for name, part in kernel(block, other).items():
                    total[name] += part
            found.append(pd.DataFrame({"lon": block["lon"], "lat": block["lat"], **total}))
        return pd.concat(found)

    schema = ", ".join(f"{c} double" for c in ("lon", "lat", *outputs))
    met = both.groupBy("row", "col").applyInPandas(run, schema)
    return met.groupBy("lon", "lat").agg(*[F.sum(o).alias(o) for o in outputs])
