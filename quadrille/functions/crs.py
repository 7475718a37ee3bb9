"""Closed-form transforms between EPSG:4326, EPSG:3857, the UTM zones (EPSG:326zz, 327zz) and projections.SYSTEMS, on columns or numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import projections

#: Sphere of web mercator, WGS 84 ellipsoid, UTM scale.
R = 6378137.0
A, FLAT, K0 = 6378137.0, 1 / 298.257223563, 0.9996
WORLD = math.pi * R

N = FLAT / (2 - FLAT)
AREA = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
C = 2 * math.sqrt(N) / (1 + N)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)


class _Columns:
    sin, cos, tan, sinh, cosh, exp, log = F.sin, F.cos, F.tan, F.sinh, F.cosh, F.exp, F.log
    arcsin, arctan, arctan2, arctanh, sqrt, radians, degrees, floor, power = F.asin, F.atan, F.atan2, F.atanh, F.sqrt, F.radians, F.degrees, F.floor, F.power


def _lib(x):
    return _Columns if isinstance(x, Column) else np


def lonlat_to_mercator(lon, lat):
    m = _lib(lon)
    return m.radians(lon) * R, m.log(m.tan(m.radians(lat) / 2 + math.pi / 4)) * R


def mercator_to_lonlat(x, y):
    m = _lib(x)
    return m.degrees(x / R), m.degrees(m.arctan(m.exp(y / R)) * 2 - math.pi / 2)


def utm_zone(epsg: int) -> tuple[float, float]:
    """(central meridian, false northing)"""
    return 6.0 * (epsg % 100) - 183, 1e7 if epsg // 100 == 327 else 0.0


def lonlat_to_utm(lon, lat, epsg: int):
    m = _lib(lon)
    lon0, north0 = utm_zone(epsg)
    s = m.sin(m.radians(lat))
    t = m.sinh(m.arctanh(s) - m.arctanh(s * C) * C)
    d = m.radians(lon - lon0)
    xi, eta = m.arctan2(t, m.cos(d)), m.arctanh(m.sin(d) / m.sqrt(t * t + 1))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east = east + m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * a
        north = north + m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * a
    return east * (K0 * AREA) + 5e5, north * (K0 * AREA) + north0


def utm_to_lonlat(x, y, epsg: int):
    m = _lib(x)
    lon0, north0 = utm_zone(epsg)
    xi, eta = (y - north0) / (K0 * AREA), (x - 5e5) / (K0 * AREA)
    p, q = xi, eta
    for j, b in enumerate(BETA, 1):
        p = p - m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * b
        q = q - m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * b
    chi = m.arcsin(m.sin(p) / m.cosh(q))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + m.sin(chi * (2 * j)) * d
    return m.degrees(m.arctan2(m.sinh(q), m.cos(p))) + lon0, m.degrees(phi)


def is_utm(epsg: int) -> bool:
    return epsg // 100 in (326, 327) and 1 <= epsg % 100 <= 60


def known(epsg: int) -> bool:
    return epsg in (4326, 3857) or is_utm(epsg) or epsg in projections.SYSTEMS


def transform(x, y, from_epsg: int, to_epsg: int):
    """Coordinates in x, y (lon, lat) order. Columns give null where a point has no image; numbers raise."""
    if from_epsg == to_epsg:
        return x, y
    for e in (from_epsg, to_epsg):
        if not known(e):
            raise NotImplementedError(f"EPSG:{e}: only 4326, 3857, the UTM zones and {sorted(projections.SYSTEMS)} are supported")
    if from_epsg == 3857:
        x, y = mercator_to_lonlat(x, y)
    elif is_utm(from_epsg):
        x, y = utm_to_lonlat(x, y, from_epsg)
    elif from_epsg != 4326:
        lon, y = projections.system(from_epsg).back(_lib(x), x, y)
        x = turned(lon)
    column = isinstance(x, Column)
    if not column:
        x, y = np.asarray(x, float), np.asarray(y, float)
    if to_epsg == 4326:
        return (x, y) if column else _finite(x, y)
    if to_epsg in projections.SYSTEMS:
        system = projections.system(to_epsg)
        if column and isinstance(system, projections.Conformal):
            y = F.when(y * math.copysign(1.0, system.n) > -90, y)  # the cone's open end
        out = system.forward(_lib(x), x, y)
        return out if column else _finite(*out)
    if column:
        y = F.when(F.abs(y) < 90, y)
        return lonlat_to_mercator(x, y) if to_epsg == 3857 else lonlat_to_utm(x, y, to_epsg)
    if (np.abs(y) >= 90).any():
        raise ValueError("a pole has no image in the target CRS")
    return _finite(*(lonlat_to_mercator(x, y) if to_epsg == 3857 else lonlat_to_utm(x, y, to_epsg)))


def turned(lon):
    """Longitudes within half a turn of 0."""
    if isinstance(lon, Column):
        return F.when(F.abs(lon) > 180, F.pmod(lon + 180, F.lit(360.0)) - 180).otherwise(lon)
    return np.where(np.abs(lon) > 180, np.mod(np.asarray(lon) + 180, 360.0) - 180, lon)


def _finite(x, y):
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise ValueError("a point has no image in the target CRS")
    return x, y


def corners(box: Sequence):
    minx, miny, maxx, maxy = box
    return [(minx, miny), (minx, maxy), (maxx, maxy), (maxx, miny)]


def box_of(points: Sequence[tuple]):
    xs, ys = zip(*points, strict=True)
    if isinstance(xs[0], Column):
        return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)
    return tuple(float(v) for v in (min(xs), min(ys), max(xs), max(ys)))


def reproject_bounds(box: Sequence, from_epsg: int, to_epsg: int):
    """The box of the four corners' images; edges are not densified."""
    if from_epsg == to_epsg:
        return tuple(box)
    return box_of([transform(x, y, from_epsg, to_epsg) for x, y in corners(box)])


def affine_corners(a: Sequence, ysize, xsize) -> list[tuple]:
    """A raster's corners under its affine (a, b, c, d, e, f; more elements are ignored)."""
    return [(a[0] * i + a[1] * j + a[2], a[3] * i + a[4] * j + a[5]) for i, j in ((0 * xsize, 0 * ysize), (0 * xsize, ysize), (xsize, ysize), (xsize, 0 * ysize))]


def affine_bounds(a: Sequence, ysize, xsize, from_epsg: int, to_epsg: int):
    """The box of a raster's corners under its affine."""
    return box_of([transform(x, y, from_epsg, to_epsg) for x, y in affine_corners(a, ysize, xsize)])


def points(pairs: Sequence[tuple[Column, Column]]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in pairs])


def images(pts: Column, source: Column, codes: Sequence[int], to_epsg: int) -> Column:
    """Points of an array in another CRS. Each CRS that occurs is in the plan once, not once a point and use."""

    def mapped(code: int) -> Column:
        def one(p: Column) -> Column:
            x, y = transform(p["x"], p["y"], code, to_epsg)
            return F.struct(x.alias("x"), y.alias("y"))

        return F.transform(pts, one)

    out = F.when(F.lit(False), pts)
    for code in codes:
        out = out.when(source == code, mapped(code))
    return out


def box_of_points(pts: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def tile_bounds(z, x, y):
    """Web-mercator box of a slippy-map tile."""
    size = 2 * WORLD / (F.pow(F.lit(2.0), z) if isinstance(z, Column) else 2.0**z)
    left, top = x * size - WORLD, WORLD - y * size
    return left, top - size, left + size, top


def tile_of(lon: Column, lat: Column, z) -> tuple[Column, Column]:
    """(x, y) of the tile that holds a point."""
    mx, my = lonlat_to_mercator(lon, lat)
    n = F.pow(F.lit(2.0), z if isinstance(z, Column) else F.lit(float(z)))
    inside = lambda v: F.greatest(F.lit(0), F.least((n - 1).cast("int"), F.floor(v * n).cast("int")))
    return inside(mx / (2 * WORLD) + 0.5), inside(0.5 - my / (2 * WORLD))


def auto_zoom(lat: Column, size_m: Column) -> Column:
    """The zoom at which an extent of this many metres fills about 800 screen pixels of 256-pixel tiles."""
    return F.ceil(F.log2(F.cos(F.radians(lat)) * 40075016.686 * 800.0 / (size_m * 256.0))).cast("int")
