"""Distance and grid expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in km.
EARTH_KM = 6371.0


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2.0 * EARTH_KM * F.asin(F.sqrt(h))


def in_box(lon: Column, lat: Column, south: float = -60.0, north: float = 84.0) -> Column:
    return lat.between(south, north) & lon.between(-180.0, 180.0)


def plane_cells(x: Column, y: Column, side: Column | float) -> list[Column]:
    return [F.floor(x / side).cast("int"), F.floor(y / side).cast("int")]


def neighbour_cells(cells: list[Column]) -> Column:
    """Array of the cell itself and every adjacent cell, as arrays of coordinates."""
    offsets: list[list[int]] = [[]]
    for _ in cells:
        offsets = [prefix + [step] for prefix in offsets for step in (-1, 0, 1)]
    return F.array(*[F.array(*[c + F.lit(o) for c, o in zip(cells, step)]) for step in offsets])
