"""Polygons as columns: their edges, whether they hold a point, whether they share a point with a box."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

POLYGON, MULTIPOLYGON = "array<array<array<double>>>", "array<array<array<array<double>>>>"


def _edge(a: Column, b: Column) -> Column:
    return F.struct(F.get(a, 0).alias("ax"), F.get(a, 1).alias("ay"), F.get(b, 0).alias("bx"), F.get(b, 1).alias("by"))


def edges_of_ring(ring: Column) -> Column:
    """Edges of a ring of points (arrays of x, y and more); the last point is joined to the first."""
    return F.transform(ring, lambda p, i: _edge(p, F.get(ring, (i + 1) % F.size(ring))))


def edges(rings: Column) -> Column:
    """Edges of all rings of polygons: rings within rings are holes."""
    return F.flatten(F.transform(rings, edges_of_ring))


def edges_of_geojson(text: Column) -> Column:
    """Of a Polygon, a MultiPolygon, or a Feature with one; null for what is neither."""
    geometry = F.coalesce(F.get_json_object(text, "$.geometry"), text)
    kind, rings = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    return F.when(kind == "Polygon", edges(F.from_json(rings, POLYGON))).when(kind == "MultiPolygon", edges(F.flatten(F.from_json(rings, MULTIPOLYGON))))


def literal_edges(rings: Sequence[Sequence[Sequence[float]]]) -> Column:
    return edges(F.array(*[F.array(*[F.array(*[F.lit(float(v)) for v in p[:2]]) for p in r]) for r in rings]))


def box_of_edges(e: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(e, lambda p: p["ax"]), F.transform(e, lambda p: p["ay"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def contains(e: Column, x: Column, y: Column) -> Column:
    """By the number of edges that a ray to the right crosses; points on an edge may count or not."""

    def crossed(p: Column) -> Column:
        at = p["ax"] + F.try_divide((p["bx"] - p["ax"]) * (y - p["ay"]), p["by"] - p["ay"])
        return ((p["ay"] > y) != (p["by"] > y)) & F.coalesce(x < at, F.lit(False))

    return F.aggregate(e, F.lit(False), lambda odd, p: odd != crossed(p))


def meets_box(e: Column, box: Sequence[Column]) -> Column:
    """Whether a polygon and a box share a point, be it on their borders.

    They do if an edge reaches the box: their ranges overlap, and the box's corners aren't all on one side of the edge's
    line. If none does, the one is within the other or they are apart, and a corner of the box tells which.
    """
    minx, miny, maxx, maxy = box

    def reaches(p: Column) -> Column:
        near = (F.least(p["ax"], p["bx"]) <= maxx) & (F.greatest(p["ax"], p["bx"]) >= minx) & (F.least(p["ay"], p["by"]) <= maxy) & (F.greatest(p["ay"], p["by"]) >= miny)
        side = [(p["bx"] - p["ax"]) * (cy - p["ay"]) - (p["by"] - p["ay"]) * (cx - p["ax"]) for cx in (minx, maxx) for cy in (miny, maxy)]
        return near & (F.least(*side) <= 0) & (F.greatest(*side) >= 0)

    return F.exists(e, reaches) | contains(e, minx, miny)
