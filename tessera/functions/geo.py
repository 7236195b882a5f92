"""Geometry on points struct<lat, lon>."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.7714
#: Metres of each unit of distance.
UNITS = {"mm": 0.001, "cm": 0.01, "m": 1.0, "km": 1000.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344, "miles": 1609.344, "nmi": 1852.0, "NM": 1852.0}


def metres(distance: str | float) -> float:
    if isinstance(distance, (int, float)):
        return float(distance)
    m = re.fullmatch(r"\s*([0-9.]+)\s*([A-Za-z]*)\s*", distance)
    if not m or (m[2] and m[2] not in UNITS):
        raise ValueError(f"not a distance: {distance}")
    return float(m[1]) * UNITS[m[2] or "m"]


def point(p) -> tuple[float, float]:
    """(lat, lon) of a dict, a 'lat,lon' string or a [lon, lat] pair."""
    if isinstance(p, str):
        lat, lon = p.split(",")
        return float(lat), float(lon)
    if isinstance(p, dict):
        return float(p["lat"]), float(p["lon"])
    return float(p[1]), float(p[0])


def distance(c: Column, lat: float, lon: float) -> Column:
    """Great-circle distance in metres."""
    a, b = F.radians(c["lat"]), F.radians(F.lit(lat))
    h = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(c["lon"] - F.lit(lon)) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def in_box(c: Column, top: float, left: float, bottom: float, right: float) -> Column:
    """A box whose left edge is east of its right one crosses the 180th meridian."""
    across = c["lon"].between(left, right) if left <= right else (c["lon"] >= left) | (c["lon"] <= right)
    return c["lat"].between(bottom, top) & across


def in_polygon(c: Column, corners: list[tuple[float, float]]) -> Column:
    """By the number of edges that a ray to the east meets."""
    met = F.lit(0)
    for (lat1, lon1), (lat2, lon2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if lat1 == lat2:
            continue
        spans = (F.lit(lat1) > c["lat"]) != (F.lit(lat2) > c["lat"])
        at = (c["lat"] - lat1) * (lon2 - lon1) / (lat2 - lat1) + lon1
        met = met + F.when(spans & (c["lon"] < at), 1).otherwise(0)
    return F.pmod(met, F.lit(2)) == 1
