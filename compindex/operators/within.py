"""Points in polygons, by cells that follow the density of the points.

Distinct locations fall into the leaves of a tree of cells over the frame they fill. A polygon is placed in the few cells
of about its own size and meets the leaves below and above them. For each leaf that it touches, its edges are cut once: an edge wholly
to the right of the leaf that spans the leaf's full height is crossed by the ray of every location in it, so it only
counts towards the leaf's parity; edges to the left, above and below are dropped, and only the rest travels to the locations.
A leaf wholly inside or outside a polygon has no edges left and is settled as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compindex.operators import celltree as CT
from compindex.operators.order import attach
from compindex.session import cut_lineage

AXES = ("_u", "_v")
# Leaves of one polygon whose edges are cut in one row.
CUT = 256


def ring_edges(rings: Column) -> Column:
    """All edges of all rings; rings are closed, holes are rings like any other."""
    ends = lambda r: F.transform(
        F.sequence(F.lit(1), F.size(r) - 1),
        lambda i: F.struct(
            F.get(r, i - 1)["x"].alias("x1"), F.get(r, i - 1)["y"].alias("y1"),
            F.get(r, i)["x"].alias("x2"), F.get(r, i)["y"].alias("y2"),
        ),
    )
    return F.flatten(F.transform(rings, ends))


def crossing_code(edges: Column, base: Column, lon: Column, lat: Column) -> Column:
    """Parity of the edges that a ray to the right crosses, beginning at ``base``; below zero on an edge."""
    cross = lambda e: (e["x2"] - e["x1"]) * (lat - e["y1"]) - (e["y2"] - e["y1"]) * (lon - e["x1"])
    spans = lambda e: (e["y1"] > lat) != (e["y2"] > lat)
    # the crossing lies to the right of the point when the cross product has the sign of the climb
    hits = lambda e: spans(e) & ((cross(e) > 0) == (e["y2"] > e["y1"])) & (cross(e) != 0)
    touches = lambda e: (
        (cross(e) == 0)
        & lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )
    return F.aggregate(edges, base, lambda acc, e: F.when((acc < 0) | touches(e), F.lit(-1)).otherwise((acc + hits(e).cast("int")) % 2))


def points_within(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Points (lon, lat, ..) strictly inside a polygon (id, rings), with the polygon's id as ``unit``.

    A point inside several polygons has a row for each; points on an edge or without a place match none.
    """
    locs = cut_lineage(points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select("lon", "lat").distinct())
    found = located_units(locs, polygons)
    return attach(points, found, ["lon", "lat"]).select(*points.columns, "unit")


def located_units(locs: DataFrame, polygons: DataFrame) -> DataFrame:
    """(lon, lat, unit) of distinct locations."""
    frame = locs.agg(*[f(c).alias(f"{n}_{c}") for c in ("lon", "lat") for n, f in (("lo", F.min), ("hi", F.max))]).first().asDict()
    low = {a: frame[f"lo_{c}"] or 0.0 for a, c in zip(AXES, ("lon", "lat"))}
    wide = {a: max((frame[f"hi_{c}"] or 0.0) - low[a], 1e-9) for a, c in zip(AXES, ("lon", "lat"))}
    last = (1 << CT.DEPTH) - 1

    def index(axis: str, value: Column) -> Column:
        return F.least(F.greatest(F.floor((value - low[axis]) / wide[axis] * (1 << CT.DEPTH)), F.lit(0)), F.lit(last)).cast("int")

    leaved = cut_lineage(CT.with_leaves(locs.withColumns({"i_u": index("_u", F.col("lon")), "i_v": index("_v", F.col("lat"))}), AXES))
    ends = [f(c).alias(f"{c}_{n}") for c in ("lon", "lat") for n, f in (("lo", F.min), ("hi", F.max))]
    leaves = leaved.groupBy("level", "cell").agg(*ends, F.min("i_u").alias("i_u"), F.min("i_v").alias("i_v"))
    leaves = cut_lineage(leaves.select(F.struct("level", "cell", "lon_lo", "lon_hi", "lat_lo", "lat_hi").alias("leaf"), "level", "i_u", "i_v"))
    above = leaves.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("level"))))
    above = above.select("leaf", "at", CT.cell_of(F.col("at"), AXES).alias("at_cell"), (F.col("at") == F.col("level")).alias("is_leaf"))

    shapes = cut_lineage(polygons.select(F.col("id").alias("unit"), ring_edges(F.col("rings")).alias("edges")).where(F.size("edges") > 0))
    shapes = cut_lineage(shapes.withColumn("shape", F.monotonically_increasing_id()))
    end = lambda pick, k: pick(F.flatten(F.array(F.transform("edges", lambda e: e[f"{k}1"]), F.transform("edges", lambda e: e[f"{k}2"]))))
    boxes = shapes.select("shape", *[end(pick, k).alias(f"{k}_{n}") for k in "xy" for n, pick in (("lo", F.array_min), ("hi", F.array_max))])
    boxes = boxes.where((F.col("x_hi") >= low["_u"]) & (F.col("x_lo") <= low["_u"] + wide["_u"]) & (F.col("y_hi") >= low["_v"]) & (F.col("y_lo") <= low["_v"] + wide["_v"]))
    placed = placed_boxes(boxes, index, wide)
    met = attach(above, placed, ["at", "at_cell"]).where("is_own OR is_leaf").where(
        (F.col("leaf.lon_hi") >= F.col("x_lo")) & (F.col("leaf.lon_lo") <= F.col("x_hi")) & (F.col("leaf.lat_hi") >= F.col("y_lo")) & (F.col("leaf.lat_lo") <= F.col("y_hi"))
    )
    met = cut_lineage(met.select("shape", "leaf").distinct())
    parts = met.groupBy("shape").agg(F.ceil(F.count(F.lit(1)) / CUT).alias("parts"))
    dealt = attach(met, parts, ["shape"]).withColumn("part", F.pmod(F.xxhash64("leaf"), F.col("parts")))
    dealt = dealt.groupBy("shape", "part").agg(F.collect_list("leaf").alias("leaves")).join(shapes, "shape")
    cut = cut_lineage(dealt.select("unit", F.inline(F.transform("leaves", lambda c: cut_edges(c, F.col("edges"))))).where("base = 1 OR size(edges) > 0"))
    inside = leaved.join(cut, ["level", "cell"]).where(crossing_code(F.col("edges"), F.col("base"), F.col("lon"), F.col("lat")) == 1)
    return inside.select("lon", "lat", "unit")


def placed_boxes(boxes: DataFrame, index: Callable[[str, Column], Column], wide: dict[str, float]) -> DataFrame:
    """Boxes in the cells of about their own size (``is_own``), and in those above, for leaves that are larger than they are."""
    size = F.greatest((F.col("x_hi") - F.col("x_lo")) / wide["_u"], (F.col("y_hi") - F.col("y_lo")) / wide["_v"], F.lit(2.0 ** -CT.DEPTH))
    own = F.least(F.greatest(F.floor(-F.log2(size)), F.lit(0)), F.lit(CT.DEPTH)).cast("int")
    shift = lambda c: F.call_function("shiftright", c, (F.lit(CT.DEPTH) - F.col("own")).cast("int"))
    grid = lambda axis, k: F.explode(F.sequence(shift(index(axis, F.col(f"{k}_lo"))), shift(index(axis, F.col(f"{k}_hi")))))
    cells = boxes.withColumn("own", own).withColumn("cu", grid("_u", "x")).withColumn("cv", grid("_v", "y"))
    finest = lambda c: F.call_function("shiftleft", F.col(c), (F.lit(CT.DEPTH) - F.col("own")).cast("int"))
    cells = cells.withColumns({"i_u": finest("cu"), "i_v": finest("cv"), "at": F.explode(F.sequence(F.lit(0), F.col("own")))})
    named = cells.select("shape", "x_lo", "x_hi", "y_lo", "y_hi", "at", CT.cell_of(F.col("at"), AXES).alias("at_cell"), (F.col("at") == F.col("own")).alias("is_own"))
    return named.distinct()


def cut_edges(leaf: Column, edges: Column) -> Column:
    """What a polygon's edges mean to the locations of a leaf: (level, cell, base, edges)."""
    low = lambda e, k: F.least(e[f"{k}1"], e[f"{k}2"])
    high = lambda e, k: F.greatest(e[f"{k}1"], e[f"{k}2"])
    always = lambda e: (low(e, "x") > leaf["lon_hi"]) & (low(e, "y") <= leaf["lat_lo"]) & (high(e, "y") > leaf["lat_hi"])
    near = lambda e: (high(e, "x") >= leaf["lon_lo"]) & (high(e, "y") >= leaf["lat_lo"]) & (low(e, "y") <= leaf["lat_hi"])
    return F.struct(
        leaf["level"].alias("level"), leaf["cell"].alias("cell"), (F.size(F.filter(edges, always)) % 2).alias("base"),
        F.filter(edges, lambda e: near(e) & ~always(e)).alias("edges"),
    )
