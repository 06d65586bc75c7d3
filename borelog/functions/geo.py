"""Places: distances, similarity of wells, local coordinates, intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def local_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of a point, by the equirectangular projection."""
    metre = EARTH_M * 3.141592653589793 / 180
    return (lon - lon0) * metre * F.cos(F.radians(lat0)), (lat - lat0) * metre


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; null where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def similarity(distance: Column, shared: Column, td1: Column, td2: Column) -> Column:
    """Weighted nearness, common layers and depth; a missing part counts 0."""
    near = 0.4 * F.exp(-distance / 5000)
    return near + 0.4 * F.coalesce(shared, F.lit(0.0)) + 0.2 * F.when(td1.isNotNull() & td2.isNotNull() & (F.greatest(td1, td2) > 0), F.least(td1, td2) / F.greatest(td1, td2)).otherwise(0.0)


def overlap(top1: Column, base1: Column, top2: Column, base2: Column) -> Column:
    """Metres that two intervals share; null where an end is unknown."""
    known = top1.isNotNull() & base1.isNotNull() & top2.isNotNull() & base2.isNotNull()
    return F.when(known, F.greatest(F.lit(0.0), F.least(base1, base2) - F.greatest(top1, top2)))
