"""Distances, cells and areas as Column functions. Planes are local and in kilometres."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius, kilometres in a degree of latitude, and slack of a cell's covering circle.
EARTH_KM, KM_PER_DEGREE, RADIUS_SLACK = 6371.0088, 111.32, 1.002
Ring = Sequence[tuple[float, float]]


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lng2) - F.radians(lng1)) / 2), 2)
    # least passes over nulls; an unknown place is at no distance.
    return F.when(a.isNotNull(), F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def geo_cell(degrees: Column, size: float = 0.05) -> Column:
    """The grid cell of a coordinate, truncated toward zero."""
    return (degrees / F.lit(size)).cast("int")


def geo_similarity(km: Column, full: float = 0.1, zero: float = 2.0) -> Column:
    """1 up to `full` km, falling to 0 at `zero`; null for an unknown distance."""
    return F.when(km.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (km - full) / (zero - full))))


def to_km(lat: Column, lng: Column, ref_lat: float, ref_lng: float) -> tuple[Column, Column]:
    """(x, y) in the plane that touches at the reference."""
    return (lng - ref_lng) * (KM_PER_DEGREE * math.cos(math.radians(ref_lat))), (lat - ref_lat) * KM_PER_DEGREE


def from_km(x: Column, y: Column, ref_lat: float, ref_lng: float) -> tuple[Column, Column]:
    return y / KM_PER_DEGREE + ref_lat, x / (KM_PER_DEGREE * math.cos(math.radians(ref_lat))) + ref_lng


def circle_ring(radius_km: float, segments: int = 256) -> list[tuple[float, float]]:
    return [(radius_km * math.cos(2 * math.pi * i / segments), radius_km * math.sin(2 * math.pi * i / segments)) for i in range(segments)]


def ring_area(ring: Ring) -> float:
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True))) / 2


def _edges(ring: Ring) -> list[tuple[float, float, float, float]]:
    return [(x1, y1, x2, y2) for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True)]


def in_ring(x: Column, y: Column, ring: Ring) -> Column:
    """Ray casting: an odd number of edges cross the half-line to the right. The ring is a short literal."""
    crossings = F.lit(0)
    for x1, y1, x2, y2 in _edges(ring):
        if y1 != y2:
            at = F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1))
            crossings = crossings + F.when(((y1 > y) != (y2 > y)) & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def ring_distance(x: Column, y: Column, ring: Ring) -> Column:
    """Kilometres from a point to the nearest edge."""
    each = []
    for x1, y1, x2, y2 in _edges(ring):
        length = (x2 - x1) ** 2 + (y2 - y1) ** 2 or 1.0
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / length))
        each.append(F.sqrt(F.pow(x - (x1 + t * (x2 - x1)), 2) + F.pow(y - (y1 + t * (y2 - y1)), 2)))
    return F.least(*each) if len(each) > 1 else each[0]


def in_tolerant_ring(x: Column, y: Column, ring: Ring, tolerance_km: float) -> Column:
    """Inside the ring, or no farther than the tolerance outside."""
    return in_ring(x, y, ring) | (ring_distance(x, y, ring) <= tolerance_km)
