"""Closed forms of six projections of the ellipsoid, on columns or numbers: azimuthal and conical equal-area, polar stereographic,
conical conformal, transverse Mercator and sinusoidal, and the step from WGS 84 to older datums.

Each is set up once for its parameters and then maps lon, lat in degrees to metres and back. Latitudes come back by the
series in the authalic or conformal latitude, which are exact to less than a millimetre.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-major axis, and flattenings of WGS 84 and GRS 80.
A, WGS84, GRS80 = 6378137.0, 1 / 298.257223563, 1 / 298.257222101
#: Method and parameters by EPSG code. Equal-area: latitude and longitude of origin (and parallels), false
#: easting and northing. Polar: pole, scale there or else the parallel of true scale, longitude of origin, false values.
SYSTEMS = {
    3035: ("azimuthal", GRS80, 52.0, 10.0, 4321000.0, 3210000.0),
    5070: ("conical", GRS80, 23.0, -96.0, 29.5, 45.5, 0.0, 0.0),
    3005: ("conical", GRS80, 45.0, -126.0, 50.0, 58.5, 1000000.0, 0.0),
    3338: ("conical", GRS80, 50.0, -154.0, 55.0, 65.0, 0.0, 0.0),
    3577: ("conical", GRS80, 0.0, 132.0, -18.0, -36.0, 0.0, 0.0),
    32661: ("polar", WGS84, 1, 0.994, None, 0.0, 2000000.0, 2000000.0),
    32761: ("polar", WGS84, -1, 0.994, None, 0.0, 2000000.0, 2000000.0),
    5041: ("polar", WGS84, 1, 0.994, None, 0.0, 2000000.0, 2000000.0),
    5042: ("polar", WGS84, -1, 0.994, None, 0.0, 2000000.0, 2000000.0),
    3413: ("polar", WGS84, 1, None, 70.0, -45.0, 0.0, 0.0),
    3995: ("polar", WGS84, 1, None, 71.0, 0.0, 0.0, 0.0),
    3031: ("polar", WGS84, -1, None, 71.0, 0.0, 0.0, 0.0),
    3976: ("polar", WGS84, -1, None, 70.0, 0.0, 0.0, 0.0),
}
#: Axis and flattening of other ellipsoids.
GRS, AIRY, BESSEL = (A, GRS80), (6377563.396, 1 / 299.3249646), (6377397.155, 1 / 299.1528128)
#: Shifts (m), turns (seconds of arc, position vector) and scale (ppm) that lead from a datum to WGS 84.
OSGB36 = (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489)
DHDN = (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)
#: Fixed values. Conformal: origin, parallels of true scale, false values. Transverse: origin, scale, false values, datum.
SYSTEMS |= {
    2154: ("conformal", GRS, 46.5, 3.0, 49.0, 44.0, 700000.0, 6600000.0),
    3034: ("conformal", GRS, 52.0, 10.0, 35.0, 65.0, 4000000.0, 2800000.0),
    3978: ("conformal", GRS, 49.0, -95.0, 49.0, 77.0, 0.0, 0.0),
    3979: ("conformal", GRS, 49.0, -95.0, 49.0, 77.0, 0.0, 0.0),
    3112: ("conformal", GRS, 0.0, 134.0, -18.0, -36.0, 0.0, 0.0),
    2180: ("transverse", GRS, 0.0, 19.0, 0.9993, 500000.0, -5300000.0),
    2193: ("transverse", GRS, 0.0, 173.0, 0.9996, 1600000.0, 10000000.0),
    3067: ("transverse", GRS, 0.0, 27.0, 0.9996, 500000.0, 0.0),
    27700: ("transverse", AIRY, 49.0, -2.0, 0.9996012717, 400000.0, -100000.0, OSGB36),
}
#: Zones of 6 degrees of ETRS89 and NAD83, and of 3 degrees of DHDN.
SYSTEMS |= {25800 + z: ("transverse", GRS, 0.0, 6.0 * z - 183, 0.9996, 500000.0, 0.0) for z in range(28, 39)}
SYSTEMS |= {26900 + z: ("transverse", GRS, 0.0, 6.0 * z - 183, 0.9996, 500000.0, 0.0) for z in range(1, 24)}
SYSTEMS |= {31464 + z: ("transverse", BESSEL, 0.0, 3.0 * z, 1.0, 1e6 * z + 500000, 0.0, DHDN) for z in range(2, 6)}
#: The sinusoidal grid of MODIS, on its sphere. It has no EPSG code; numbers above 100,000 are this library's own.
MODIS = 100001
SYSTEMS[MODIS] = ("sinusoidal", 6371007.181, 0.0)


#: From some values to others.
Step = Callable[..., tuple]


class Ellipsoid:
    def __init__(self, flat: float):
        self.e2 = e2 = flat * (2 - flat)
        self.e = math.sqrt(e2)
        self.authalic = (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360)
        self.conformal = (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520, 7 * e2**3 / 120 + 81 * e2**4 / 1120, 4279 * e2**4 / 161280)

    def q(self, m, s):
        """Twice the area up to a latitude, by its sine, for a unit of longitude and axis."""
        return (s / (1 - s * s * self.e2) - m.log((1 - s * self.e) / (1 + s * self.e)) / (2 * self.e)) * (1 - self.e2)

    def width(self, phi: float) -> float:
        """Radius of a parallel in units of the axis."""
        return math.cos(phi) / math.sqrt(1 - self.e2 * math.sin(phi) ** 2)

    @staticmethod
    def series(m, x, factors):
        """The latitude of an auxiliary one."""
        out = x
        for k, c in enumerate(factors, 1):
            out = out + m.sin(x * (2 * k)) * c
        return out


class _Math:
    sin, cos, log, arctanh = math.sin, math.cos, math.log, math.atanh


@dataclass
class Azimuthal:
    flat: float
    lat0: float
    lon0: float
    east0: float
    north0: float

    def __post_init__(self):
        self.ell = e = Ellipsoid(self.flat)
        phi = math.radians(self.lat0)
        self.qp = e.q(_Math, 1.0)
        self.beta = math.asin(e.q(_Math, math.sin(phi)) / self.qp)
        self.radius = A * math.sqrt(self.qp / 2)
        self.d = A * e.width(phi) / (self.radius * math.cos(self.beta))

    def forward(self, m, lon, lat):
        s = self.ell.q(m, m.sin(m.radians(lat))) / self.qp  # sine of the authalic latitude
        c, turn = m.sqrt(1 - s * s), m.radians(lon - self.lon0)
        s0, c0 = math.sin(self.beta), math.cos(self.beta)
        b = m.sqrt(2 / (s * s0 + 1 + c * m.cos(turn) * c0)) * self.radius
        return b * c * m.sin(turn) * self.d + self.east0, b * (s * c0 - c * m.cos(turn) * s0) / self.d + self.north0

    def back(self, m, x, y):
        u, v = (x - self.east0) / self.d, (y - self.north0) * self.d
        half = m.arcsin(m.sqrt(u * u + v * v) / (2 * self.radius))
        k, c = m.cos(half) / self.radius, m.cos(half * 2)  # k is the sine of the whole angle by its chord
        s0, c0 = math.sin(self.beta), math.cos(self.beta)
        beta = m.arcsin(c * s0 + v * k * c0)
        return m.degrees(m.arctan2(u * k, c * c0 - v * k * s0)) + self.lon0, m.degrees(self.ell.series(m, beta, self.ell.authalic))


@dataclass
class Conical:
    flat: float
    lat0: float
    lon0: float
    lat1: float
    lat2: float
    east0: float
    north0: float

    def __post_init__(self):
        self.ell = e = Ellipsoid(self.flat)
        q0, q1, q2 = (e.q(_Math, math.sin(math.radians(x))) for x in (self.lat0, self.lat1, self.lat2))
        w1, w2 = (e.width(math.radians(x)) ** 2 for x in (self.lat1, self.lat2))
        self.n = (w1 - w2) / (q2 - q1)
        self.c = w1 + self.n * q1
        self.qp = e.q(_Math, 1.0)
        self.rho0 = A * math.sqrt(self.c - self.n * q0) / self.n

    def forward(self, m, lon, lat):
        rho = m.sqrt(self.c - self.ell.q(m, m.sin(m.radians(lat))) * self.n) * (A / self.n)
        turn = m.radians(lon - self.lon0) * self.n
        return rho * m.sin(turn) + self.east0, self.rho0 - rho * m.cos(turn) + self.north0

    def back(self, m, x, y):
        u, v = x - self.east0, self.rho0 - (y - self.north0)
        sign = math.copysign(1.0, self.n)
        q = (self.c - (u * u + v * v) * (self.n / A) ** 2) / self.n
        beta = m.arcsin(q / self.qp)
        return m.degrees(m.arctan2(u * sign, v * sign)) / self.n + self.lon0, m.degrees(self.ell.series(m, beta, self.ell.authalic))


@dataclass
class Polar:
    flat: float
    pole: int
    scale: float | None
    parallel: float | None
    lon0: float
    east0: float
    north0: float

    def __post_init__(self):
        self.ell = e = Ellipsoid(self.flat)
        self.unit = math.sqrt((1 + e.e) ** (1 + e.e) * (1 - e.e) ** (1 - e.e))
        if self.scale is None:
            phi = math.radians(self.parallel)
            t = math.tan(math.pi / 4 - phi / 2) / ((1 - e.e * math.sin(phi)) / (1 + e.e * math.sin(phi))) ** (e.e / 2)
            self.scale = e.width(phi) * self.unit / (2 * t)

    def forward(self, m, lon, lat):
        phi, e = m.radians(lat * self.pole), self.ell.e
        s = m.sin(phi)
        rho = m.tan(math.pi / 4 - phi / 2) * m.exp(m.log((1 + s * e) / (1 - s * e)) * (e / 2)) * (2 * A * self.scale / self.unit)
        turn = m.radians(lon - self.lon0)
        return rho * m.sin(turn) + self.east0, rho * m.cos(turn) * -self.pole + self.north0

    def back(self, m, x, y):
        u, v = x - self.east0, (y - self.north0) * -self.pole
        chi = math.pi / 2 - m.arctan(m.sqrt(u * u + v * v) * (self.unit / (2 * A * self.scale))) * 2
        return m.degrees(m.arctan2(u, v)) + self.lon0, m.degrees(self.ell.series(m, chi, self.ell.conformal)) * self.pole


@dataclass
class Conformal:
    """Lambert's conical conformal projection; with one parallel, both are the same and a scale may go with it."""

    shape: tuple[float, float]
    lat0: float
    lon0: float
    lat1: float
    lat2: float
    east0: float
    north0: float
    scale: float = 1.0

    def __post_init__(self):
        axis, flat = self.shape
        self.ell = Ellipsoid(flat)
        (w1, p1), (w2, p2) = ((self.ell.width(math.radians(p)), self.isometric(_Math, math.sin(math.radians(p)))) for p in (self.lat1, self.lat2))
        self.n = math.sin(math.radians(self.lat1)) if self.lat1 == self.lat2 else math.log(w1 / w2) / (p2 - p1)
        self.unit = axis * self.scale * w1 / self.n * math.exp(p1 * self.n)
        self.rho0 = self.unit * math.exp(-self.n * self.isometric(_Math, math.sin(math.radians(self.lat0))))

    def isometric(self, m, s):
        """The isometric latitude, by the sine of the latitude."""
        return m.arctanh(s) - m.arctanh(s * self.ell.e) * self.ell.e

    def forward(self, m, lon, lat):
        rho = m.exp(self.isometric(m, m.sin(m.radians(lat))) * -self.n) * self.unit
        turn = m.radians(nearest_turn(m, lon - self.lon0)) * self.n
        return rho * m.sin(turn) + self.east0, self.rho0 - rho * m.cos(turn) + self.north0

    def back(self, m, x, y):
        sign = math.copysign(1.0, self.n)
        u, v = (x - self.east0) * sign, (self.rho0 - (y - self.north0)) * sign
        t = m.power(m.sqrt(u * u + v * v) / abs(self.unit), 1 / self.n)
        chi = math.pi / 2 - m.arctan(t) * 2
        return m.degrees(m.arctan2(u, v)) / self.n + self.lon0, m.degrees(self.ell.series(m, chi, self.ell.conformal))


@dataclass
class Transverse:
    """Transverse Mercator of any ellipsoid, by the series in its third flattening."""

    shape: tuple[float, float]
    lat0: float
    lon0: float
    scale: float
    east0: float
    north0: float
    datum: tuple | None = None

    def __post_init__(self):
        axis, flat = self.shape
        n = flat / (2 - flat)
        self.ell = Ellipsoid(flat)
        self.unit = self.scale * axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.there = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
        self.here = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
        s = math.sin(math.radians(self.lat0))
        chi = math.asin(math.tanh(math.atanh(s) - self.ell.e * math.atanh(self.ell.e * s)))
        self.origin = chi + sum(a * math.sin(2 * j * chi) for j, a in enumerate(self.there, 1))

    def there_by(self, m) -> list[Step]:
        e = self.ell.e

        def series(xi, eta):
            east, north = eta, xi - self.origin
            for j, a in enumerate(self.there, 1):
                east = east + m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * a
                north = north + m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * a
            return east * self.unit + self.east0, north * self.unit + self.north0

        return [
            lambda lon, lat: (m.sin(m.radians(lat)), m.radians(nearest_turn(m, lon - self.lon0))),
            lambda s, d: (m.sinh(m.arctanh(s) - m.arctanh(s * e) * e), d),
            lambda t, d: (m.arctan2(t, m.cos(d)), m.arctanh(m.sin(d) / m.sqrt(t * t + 1))),
            series,
        ]

    def back_by(self, m) -> list[Step]:
        def series(xi, eta):
            p, q = xi, eta
            for j, b in enumerate(self.here, 1):
                p = p - m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * b
                q = q - m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * b
            return p, q

        return [
            lambda x, y: ((y - self.north0) / self.unit + self.origin, (x - self.east0) / self.unit),
            series,
            lambda p, q: (p, q, m.arcsin(m.sin(p) / m.cosh(q))),
            lambda p, q, chi: (m.degrees(m.arctan2(m.sinh(q), m.cos(p))) + self.lon0, m.degrees(self.ell.series(m, chi, self.ell.conformal))),
        ]

    def forward(self, m, lon, lat):
        return in_turn((lon, lat), self.there_by(m))

    def back(self, m, x, y):
        return in_turn((x, y), self.back_by(m))


@dataclass
class Sinusoidal:
    """On a sphere."""

    radius: float
    lon0: float

    def forward(self, m, lon, lat):
        phi = m.radians(lat)
        return m.radians(nearest_turn(m, lon - self.lon0)) * m.cos(phi) * self.radius, phi * self.radius

    def back(self, m, x, y):
        phi = y / self.radius
        return m.degrees(x / (m.cos(phi) * self.radius)) + self.lon0, m.degrees(phi)


def nearest_turn(m, angle):
    """Degrees within half a turn of 0: a point west of the antimeridian and one east of it stay neighbours."""
    return angle - m.floor((angle + 180) / 360) * 360.0


def helmert(p: tuple, datum: tuple, inverse: bool = False) -> tuple:
    """Geocentric metres by seven parameters (to WGS 84), position vector convention, and back to first order in the turns."""
    dx, dy, dz, *turns, ppm = datum
    rx, ry, rz = (math.radians(r / 3600) * (-1 if inverse else 1) for r in turns)
    x, y, z = (p[0] - dx, p[1] - dy, p[2] - dz) if inverse else p
    k = 1 / (1 + ppm * 1e-6) if inverse else 1 + ppm * 1e-6
    x, y, z = (x - y * rz + z * ry) * k, (x * rz + y - z * rx) * k, (y * rx + z - x * ry) * k
    return (x, y, z) if inverse else (x + dx, y + dy, z + dz)


def geocentric_by(m, shape: tuple[float, float]) -> list[Step]:
    axis, flat = shape
    e2 = flat * (2 - flat)
    return [
        lambda lon, lat: (m.radians(lon), m.sin(m.radians(lat)), m.cos(m.radians(lat))),
        lambda lam, s, c: (lam, s, c, axis / m.sqrt(1 - s * s * e2)),
        lambda lam, s, c, r: (r * c * m.cos(lam), r * c * m.sin(lam), r * s * (1 - e2)),
    ]


def geocentric(m, lon, lat, shape: tuple[float, float]) -> tuple:
    """Metres from the centre of a point on the ellipsoid."""
    return in_turn((lon, lat), geocentric_by(m, shape))


def geodetic_by(m, shape: tuple[float, float]) -> list[Step]:
    axis, flat = shape
    e2, b = flat * (2 - flat), axis * (1 - flat)
    return [
        lambda x, y, z: (m.arctan2(y, x), z, m.sqrt(x * x + y * y)),
        lambda lam, z, p: (lam, z, p, m.arctan2(z * axis, p * b)),
        lambda lam, z, p, beta: (lam, z, p, m.sin(beta), m.cos(beta)),
        lambda lam, z, p, s, c: (m.degrees(lam), m.degrees(m.arctan2(z + s * s * s * (b * e2 / (1 - e2)), p - c * c * c * (axis * e2)))),
    ]


def geodetic(m, x, y, z, shape: tuple[float, float]) -> tuple:
    """lon, lat of a geocentric point, by the parametric latitude; exact to far below a millimetre near the ground."""
    return in_turn((x, y, z), geodetic_by(m, shape))


def between_by(m, datum: tuple, shape: tuple[float, float], to_wgs84: bool) -> list[Step]:
    """A point on the ground in the other datum. Heights above the ellipsoids are taken for 0."""
    a, b = (shape, (A, WGS84)) if to_wgs84 else ((A, WGS84), shape)
    return [*geocentric_by(m, a), lambda x, y, z: helmert((x, y, z), datum, inverse=not to_wgs84), *geodetic_by(m, b)]


def in_turn(values: tuple, steps: Sequence[Step]) -> tuple:
    for step in steps:
        values = step(*values)
    return values


def chain(values: tuple, steps: Sequence[Step]) -> tuple:
    """Steps from values to values. Of columns, each step is in the plan once, as the body of a function of its argument.

    Within a step, what is used twice is in the plan and made twice; a step should make what the next one uses often.
    """
    if not isinstance(values[0], Column):
        return in_turn(values, steps)

    def held(values: tuple) -> Column:
        return F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])

    out, width = F.array(held(values)), len(values)
    for step in steps:

        def body(p: Column) -> Column:
            nonlocal width
            values = step(*[p[f"v{i}"] for i in range(width)])  # noqa: B023
            width = len(values)
            return held(values)

        out = F.transform(out, body)
    return tuple(out[0][f"v{i}"] for i in range(width))


@dataclass
class Shifted:
    """A projection of a datum other than WGS 84, from and to WGS 84."""

    inner: Transverse

    def forward(self, m, lon, lat):
        i = self.inner
        return chain((lon, lat), [*between_by(m, i.datum, i.shape, False), *i.there_by(m)])

    def back(self, m, x, y):
        i = self.inner
        return chain((x, y), [*i.back_by(m), *between_by(m, i.datum, i.shape, True)])


KINDS = {"azimuthal": Azimuthal, "conical": Conical, "polar": Polar, "conformal": Conformal, "transverse": Transverse, "sinusoidal": Sinusoidal}


@functools.cache
def system(epsg: int) -> Azimuthal | Conical | Polar | Conformal | Transverse | Sinusoidal | Shifted:
    method, *parameters = SYSTEMS[epsg]
    made = KINDS[method](*parameters)
    return Shifted(made) if getattr(made, "datum", None) else made
