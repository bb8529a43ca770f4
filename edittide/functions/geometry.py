"""Points, rings and lengths with higher-order functions; no Python runs per row."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres; sphere used for way lengths.
EARTH_RADIUS = 6372797.560856

RINGS_TYPE = "array<array<struct<x:double,y:double>>>"


class GeometryError(ValueError):
    """The text is not one Feature with a polygon."""


def centroid(low: Column, high: Column) -> Column:
    return (low + high) / 2


def _segments(ring: Column) -> Column:
    n = F.size(ring)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, F.least(i + 1, n)).alias("b")))
    return F.when(n > 1, pairs)


def point_in_rings(x: Column, y: Column, rings: Column, edges: bool) -> Column:
    """Even-odd test over all rings (so holes count); a point on an edge counts only if `edges`.

    NULL coordinates give NULL; empty rings contain nothing.
    """
    segments = F.coalesce(F.flatten(F.transform(rings, _segments)), F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))

    def crosses(s: Column) -> Column:
        at = (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / F.nullif(s["b"]["y"] - s["a"]["y"], F.lit(0.0)) + s["a"]["x"]
        return F.coalesce(((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < at), F.lit(False))

    def touches(s: Column) -> Column:
        cross = (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (x - s["a"]["x"])
        within = x.between(F.least(s["a"]["x"], s["b"]["x"]), F.greatest(s["a"]["x"], s["b"]["x"])) & y.between(F.least(s["a"]["y"], s["b"]["y"]), F.greatest(s["a"]["y"], s["b"]["y"]))
        return (cross == 0) & within

    odd = F.aggregate(segments, F.lit(False), lambda acc, s: acc != crosses(s))
    edge = F.exists(segments, touches)
    inside = (odd | edge) if edges else (odd & ~edge)
    return F.when(x.isNotNull() & y.isNotNull(), inside)


def bounds(rings: Column) -> Column:
    """Smallest box around all rings, for a cheap test before the exact one."""
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_RADIUS) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2.0)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def path_length(points: Column, radius: float = EARTH_RADIUS) -> Column:
    """Length in metres along an array of struct<x,y>; 0 for fewer than two points."""
    n = F.size(points)
    legs = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: haversine(F.element_at(points, i)["x"], F.element_at(points, i)["y"], F.element_at(points, F.least(i + 1, n))["x"], F.element_at(points, F.least(i + 1, n))["y"], radius),
    )
    return F.when(n > 1, F.aggregate(legs, F.lit(0.0), lambda acc, v: acc + v)).otherwise(F.lit(0.0))


def rings_literal(polygons: Sequence[Sequence[Sequence[Sequence[float]]]]) -> Column:
    """Polygons (each an outer ring and its holes) as one array of rings."""
    rings = [[{"x": float(p[0]), "y": float(p[1])} for p in ring] for polygon in polygons for ring in polygon]
    return F.from_json(F.lit(json.dumps(rings)), RINGS_TYPE)


def read_feature(text: str) -> list:
    """Polygons of one GeoJSON Feature: all parts of a MultiPolygon, holes kept."""
    try:
        feature = json.loads(text)
    except json.JSONDecodeError as e:
        raise GeometryError(f"not JSON: {e}") from e
    if not isinstance(feature, dict) or feature.get("type") != "Feature":
        raise GeometryError("a single GeoJSON Feature is expected")
    geometry = feature.get("geometry") or {}
    kind, at = geometry.get("type"), geometry.get("coordinates") or []
    if kind not in ("Polygon", "MultiPolygon"):
        raise GeometryError(f"a Polygon or MultiPolygon is expected, not {kind}")
    polygons = [at] if kind == "Polygon" else at
    for ring in (ring for polygon in polygons for ring in polygon):
        if len(ring) < 3 or not all(len(p) >= 2 and all(math.isfinite(v) for v in p[:2]) for p in ring):
            raise GeometryError("a ring needs three finite points at least")
    return [[ring if ring[0] == ring[-1] else [*ring, ring[0]] for ring in polygon] for polygon in polygons]
