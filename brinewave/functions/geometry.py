"""Feature geometry as nested arrays: rings, polygons and their validity tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(lon, lat) -> Column:
    return F.array(lon, lat)


def rectangle(south, north, west, east) -> Column:
    """Closed [lon, lat] ring around a cell."""
    return F.array(
        point(west, south), point(east, south), point(east, north),
        point(west, north), point(west, south),
    )


def ring_closed(ring) -> Column:
    return F.element_at(ring, 1) == F.element_at(ring, -1)


def ring_is_quad(ring) -> Column:
    return (F.size(ring) == 5) & (F.size(F.array_distinct(ring)) == 4)


def ring_contains(ring, lon, lat) -> Column:
    lons = F.transform(ring, lambda p: F.element_at(p, 1))
    lats = F.transform(ring, lambda p: F.element_at(p, 2))
    return (
        (F.array_min(lons) <= lon) & (lon <= F.array_max(lons))
        & (F.array_min(lats) <= lat) & (lat <= F.array_max(lats))
    )


def ring_in_lon_lat_order(ring) -> Column:
    return F.forall(
        ring,
        lambda p: F.element_at(p, 1).between(-180, 180) & F.element_at(p, 2).between(-90, 90),
    )


def feature(geometry_type: str, coordinates: Column, properties: Column) -> Column:
    """One feature as a struct ready for ``to_json``."""
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit(geometry_type).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        properties.alias("properties"),
    )
