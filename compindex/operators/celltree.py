"""Pair statistics on the sphere by a tree of cells.

Locations fall into cubes around the unit sphere; a cube with more than ``LEAF`` locations is split in eight, so that the
tree follows the density. A cell carries the sums of its locations and the box they fill. Two cells whose boxes
lie wholly on one side of every distance that matters settle all their pairs by a product of sums; only pairs of cells
that straddle such a distance open into their children, and only pairs of leaves compare locations. With c leaves about
c^1.5 pairs of cells are met, and no row is made per pair of locations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from compindex.functions import geo as G
from compindex.operators import blocks as K
from compindex.operators.order import attach
from compindex.session import compute_tasks, cut_lineage

# Locations of a leaf; cells of the last level (12 m) are leaves whatever they hold, in blocks of this size.
LEAF = 512
DEPTH = 20
# Levels that are sized at once.
STEP = 6
# Slack of every comparison of bounds, in units of the Earth's radius: far above rounding, so doubtful pairs open.
SLACK = 1e-9
AXES = ("_x", "_y", "_z")


def _shift(column: str, bits: Column) -> Column:
    return F.call_function("shiftright", F.col(column), bits.cast("int"))


def cell_of(level: Column, axes: tuple[str, ...] = AXES) -> Column:
    """Number of the cell of that level that holds the finest cell (a column ``i<axis>`` for each axis)."""
    number = F.lit(0).cast("long")
    for a in axes:
        number = number * (1 << DEPTH) + _shift(f"i{a}", F.lit(DEPTH) - level).cast("long")
    return number


def placed(locs: DataFrame) -> DataFrame:
    """``locs`` (lon, lat) with unit vector (_x, _y, _z) and finest cell (i_x, i_y, i_z)."""
    ring = F.cos(F.radians("lat"))
    unit = {"_x": ring * F.cos(F.radians("lon")), "_y": ring * F.sin(F.radians("lon")), "_z": F.sin(F.radians("lat"))}
    index = lambda a: F.least(F.greatest(F.floor((F.col(a) + 1.0) * (1 << DEPTH - 1)), F.lit(0)), F.lit((1 << DEPTH) - 1))
    return locs.withColumns(unit).withColumns({f"i{a}": index(a).cast("int") for a in AXES})


def with_leaves(cells: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Locations (lon, lat and finest cell) with their leaf (level, cell) and block; every step sizes ``STEP`` levels at once."""
    todo, level, found = cut_lineage(cells), 0, None
    keys = [f"d{a}" for a in axes]
    while True:
        top = min(level + STEP - 1, DEPTH)
        todo = todo.withColumns({f"d{a}": _shift(f"i{a}", F.lit(DEPTH - top)) for a in axes})
        sizes = todo.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        for k in range(level, top + 1):
            upper = Window.partitionBy(*[_shift(d, F.lit(top - k)) for d in keys])
            sizes = sizes.withColumn(f"n{k}", F.sum("n").over(upper))
        first = F.coalesce(*[F.when(F.col(f"n{k}") <= LEAF, F.lit(k)) for k in range(level, top + 1)], F.lit(DEPTH if top == DEPTH else None).cast("int"))
        size = F.when(first == DEPTH, F.col("n")).otherwise(1)
        # a crowded cell must not become one join key: the size table goes to the locations
        known = cut_lineage(attach(todo, sizes.select(*keys, first.alias("level"), size.alias("in_cell")), keys).drop(*keys))
        blocks = F.ceil(F.col("in_cell") / LEAF)
        done = known.where("level IS NOT NULL").withColumn("cell", cell_of(F.col("level"), axes)).withColumn("block", F.pmod(F.xxhash64("lon", "lat"), blocks).cast("int")).drop("in_cell")
        found = done if found is None else found.unionByName(done)
        todo = known.where("level IS NULL").drop("level", "in_cell")
        if top == DEPTH or todo.isEmpty():
            return found
        level = top + 1


def nodes(leaved: DataFrame, sums: list[str]) -> DataFrame:
    """(level, cell, parent, is_leaf, centre, radius, sums): every cell of the tree.

    ``sums`` are added up as they are, and as ``<name>2`` their squares per location. The radius is half the diagonal of the box.
    """
    ends = [f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    squares = [F.sum(F.col(s) * F.col(s)).alias(f"{s}2") for s in sums]
    finest = [F.min(f"i{a}").alias(f"i{a}") for a in AXES]
    leaves = leaved.groupBy("level", "cell").agg(*[F.sum(s).alias(s) for s in sums], *squares, *ends, *finest)
    above = leaves.withColumn("leaf_level", F.col("level")).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("level"))))
    above = above.withColumn("cell", cell_of(F.col("level")))
    outer = [f(f"{n}{a}").alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    finest = [F.min(f"i{a}").alias(f"i{a}") for a in AXES]
    names = [*sums, *[f"{s}2" for s in sums]]
    cells = above.groupBy("level", "cell").agg((F.max("leaf_level") == F.col("level")).alias("is_leaf"), *[F.sum(s).alias(s) for s in names], *outer, *finest)
    half = lambda a: (F.col(f"hi{a}") - F.col(f"lo{a}")) / 2.0
    radius = F.sqrt(sum((half(a) * half(a) for a in AXES[1:]), half("_x") * half("_x")))
    centre = [((F.col(f"hi{a}") + F.col(f"lo{a}")) / 2.0).alias(f"m{a}") for a in AXES]
    parent = F.when(F.col("level") > 0, cell_of(F.col("level") - 1))
    return cells.select("level", "cell", parent.alias("parent"), "is_leaf", radius.alias("radius"), *centre, *names)


def chord(km: float) -> float:
    """Straight-line length of a great-circle distance on the unit sphere; beyond the far side there is none."""
    return 2.0 * math.sin(km / (2.0 * G.EARTH_KM)) if km < math.pi * G.EARTH_KM else math.inf


def settle(tree: DataFrame, sort: Callable[[Column, Column], Column], names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(settled, open) unordered pairs of cells, each pair of locations below exactly one of them.

    ``sort`` gives the class of a pair from the least and greatest straight-line distance it can have, null if these do not tell;
    classes below zero are dropped. Columns of the two cells are named a_ and b_. Open pairs are pairs of leaves.
    """
    tree = cut_lineage(tree)
    columns = ["level", "cell", "is_leaf", "radius", *[f"m{a}" for a in AXES], *names]
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in columns]
    below = tree.where("parent IS NOT NULL").select((F.col("level") - 1).alias("up_level"), F.col("parent").alias("up_cell"), *columns)
    # a leaf stands for itself beside the children of others
    steps = cut_lineage(below.unionByName(tree.where("is_leaf").select(F.col("level").alias("up_level"), F.col("cell").alias("up_cell"), *columns)))
    child = lambda s: steps.select(F.col("up_level").alias(f"{s}_up_level"), F.col("up_cell").alias(f"{s}_up_cell"), *side(s))
    pairs, settled, opened = tree.where("level = 0").select(*side("a"), *side("b")), None, None
    while True:
        gap = [F.col(f"a_m{a}") - F.col(f"b_m{a}") for a in AXES]
        apart, reach = F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]), F.col("a_radius") + F.col("b_radius") + SLACK
        pairs = cut_lineage(pairs.withColumn("class", sort(apart - reach, apart + reach)).where("class IS NULL OR class >= 0"))
        done = pairs.where("class IS NOT NULL")
        settled = done if settled is None else settled.unionByName(done)
        unknown = pairs.where("class IS NULL")
        leaves = unknown.where("a_is_leaf AND b_is_leaf").select("a_level", "a_cell", "b_level", "b_cell")
        opened = leaves if opened is None else opened.unionByName(leaves)
        inner = unknown.where("NOT (a_is_leaf AND b_is_leaf)")
        if inner.isEmpty():
            return settled, opened
        up = {f"{s}_up_{c}": F.col(f"{s}_{c}") for s in "ab" for c in ("level", "cell")}
        inner = inner.select(*[c.alias(n) for n, c in up.items()])
        wide = inner.join(child("a"), ["a_up_level", "a_up_cell"]).join(child("b"), ["b_up_level", "b_up_cell"])
        twins = (F.col("a_up_level") == F.col("b_up_level")) & (F.col("a_up_cell") == F.col("b_up_cell"))
        pairs = wide.where(~twins | (F.col("a_cell") <= F.col("b_cell"))).drop(*up)


def leaf_pairs(leaved: DataFrame, opened: DataFrame, columns: list[str]) -> DataFrame:
    """The locations of the open pairs of leaves, block by block, as arrays named a_ and b_; each unordered pair of blocks once."""
    arrays = cut_lineage(leaved.groupBy("level", "cell", "block").agg(*[F.collect_list(c).alias(c) for c in columns]))
    side = lambda s: arrays.select(*[F.col(c).alias(f"{s}_{c}") for c in ("level", "cell", "block", *columns)])
    joined = opened.join(side("a"), ["a_level", "a_cell"])
    # a stated number of partitions: the rows are few, but each is a comparison of blocks
    joined = joined.repartition(compute_tasks(leaved), "b_level", "b_cell", "a_cell").join(side("b"), ["b_level", "b_cell"])
    same = (F.col("a_level") == F.col("b_level")) & (F.col("a_cell") == F.col("b_cell"))
    return joined.where(~same | (F.col("a_block") <= F.col("b_block"))).withColumn("same", same & (F.col("a_block") == F.col("b_block")))


def _arrays(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[dict, dict, bool]]:
    for batch in batches:
        for row in batch.to_dict("records"):
            a, b = ({c: np.asarray(row[f"{s}_{c}"], float) for c in columns} for s in "ab")
            yield a, b, bool(row["same"])


def distance_bins(locs: DataFrame, weight: str, products: list[str], edges_km: tuple[float, ...]) -> DataFrame:
    """(bin, pairs, products): over unordered pairs of different locations with edge k <= distance < edge k + 1, the products
    of their weights and of each summed attribute."""
    sums = [weight, *products]
    leaved = cut_lineage(with_leaves(placed(locs)))
    bounds = [chord(e) for e in edges_km if chord(e) < math.inf]

    def bin_of(distance: Column) -> Column:
        return sum((F.when(distance >= e, 1).otherwise(0) for e in bounds[1:]), F.lit(0))

    settled, opened = settle(nodes(leaved, sums), lambda low, high: F.when(bin_of(low) == bin_of(high), bin_of(low)), [*sums, *[f"{s}2" for s in sums]])
    twins = (F.col("a_level") == F.col("b_level")) & (F.col("a_cell") == F.col("b_cell"))
    total = lambda s: F.when(twins, (F.col(f"a_{s}") * F.col(f"a_{s}") - F.col(f"a_{s}2")) / 2.0).otherwise(F.col(f"a_{s}") * F.col(f"b_{s}"))
    names = ["pairs", *products]
    whole = settled.groupBy(F.col("class").alias("bin")).agg(*[F.sum(total(s)).alias(n) for s, n in zip(sums, names)])
    edges = np.array(edges_km, float)
    columns = ["lon", "lat", *sums]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        added = np.zeros((len(names), len(edges) + 1))
        for a, b, same in _arrays(batches, columns):
            bins = np.searchsorted(edges, K.haversine_matrix(a["lon"], a["lat"], b["lon"], b["lat"]), side="right") - 1
            if same:
                bins[np.tril_indices(len(bins))] = len(edges)
            for k, s in enumerate(sums):
                added[k] += np.bincount(bins.ravel(), np.outer(a[s], b[s]).ravel(), len(edges) + 1)
        yield pd.DataFrame({"bin": np.arange(len(edges) - 1), **dict(zip(names, added[:, : len(edges) - 1]))})

    wanted = [f"{s}_{c}" for s in "ab" for c in columns]
    parts = leaf_pairs(leaved, opened, columns).select(*wanted, "same").mapInPandas(run, "bin int, " + ", ".join(f"{n} double" for n in names))
    return whole.unionByName(parts).groupBy("bin").agg(*[F.sum(n).alias(n) for n in names])


def band_totals(locs: DataFrame, sums: list[str], band_km: float) -> DataFrame:
    """(lon, lat, sums): for every location of ``locs`` the sums over all locations within the band, itself included.

    A cell that lies wholly within the band of another hands on its sums; they reach the locations through their leaf.
    """
    leaved = cut_lineage(with_leaves(placed(locs)))
    limit = chord(band_km)
    tree = nodes(leaved, sums)
    settled, opened = settle(tree, lambda low, high: F.when(high < limit, 1).when(low > limit, -1), sums)
    twins = (F.col("a_level") == F.col("b_level")) & (F.col("a_cell") == F.col("b_cell"))
    given = lambda to, of: [F.col(f"{to}_level").alias("level"), F.col(f"{to}_cell").alias("cell"), *[F.col(f"{of}_{s}").alias(s) for s in sums]]
    handed = settled.select(*given("a", "b")).unionByName(settled.where(~twins).select(*given("b", "a")))
    handed = handed.groupBy("level", "cell").agg(*[F.sum(s).alias(s) for s in sums])
    leaves = leaved.groupBy("level", "cell").agg(*[F.min(f"i{a}").alias(f"i{a}") for a in AXES])
    above = leaves.select(F.col("level").alias("leaf_level"), F.col("cell").alias("leaf_cell"), *[f"i{a}" for a in AXES], F.explode(F.sequence(F.lit(0), F.col("level"))).alias("level"))
    reached = above.withColumn("cell", cell_of(F.col("level"))).join(handed, ["level", "cell"]).groupBy("leaf_level", "leaf_cell").agg(*[F.sum(s).alias(s) for s in sums])
    reached = reached.select(F.col("leaf_level").alias("level"), F.col("leaf_cell").alias("cell"), *sums)
    whole = attach(leaved.select("lon", "lat", "level", "cell"), reached, ["level", "cell"]).select("lon", "lat", *sums)
    columns = ["lon", "lat", *sums]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a, b, same in _arrays(batches, columns):
            i, j, _ = K.near_pairs(a["lon"], a["lat"], b["lon"], b["lat"], band_km)
            add = lambda at, values, n: np.bincount(at, values, n)
            yield pd.DataFrame({"lon": a["lon"], "lat": a["lat"], **{s: add(i, b[s][j], len(a["lon"])) for s in sums}})
            if not same:
                yield pd.DataFrame({"lon": b["lon"], "lat": b["lat"], **{s: add(j, a[s][i], len(b["lon"])) for s in sums}})

    wanted = [f"{s}_{c}" for s in "ab" for c in columns]
    parts = leaf_pairs(leaved, opened, columns).select(*wanted, "same").mapInPandas(run, ", ".join(f"{c} double" for c in columns))
    return whole.unionByName(parts).groupBy("lon", "lat").agg(*[F.sum(s).alias(s) for s in sums])
