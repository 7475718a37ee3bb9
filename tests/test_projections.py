import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import crs, projections

#: Worked examples that are published with the methods.
EXAMPLES = [
    (projections.system(3035), (5.0, 50.0), (3962799.45, 2999718.85)),
    (projections.Conical(1 / 294.9786982, 23.0, -96.0, 29.5, 45.5, 0.0, 0.0), (-75.0, 35.0), (1885472.7, 1535925.0)),
    (projections.system(32661), (44.0, 73.0), (3320416.75, 632668.43)),
    (projections.Polar(projections.WGS84, -1, None, 71.0, 70.0, 6e6, 6e6), (120.0, -75.0), (7255380.79, 7053389.56)),
]


@pytest.mark.parametrize("system,there,want", EXAMPLES)
def test_published_examples(system, there, want):
    got = system.forward(np, *map(np.float64, there))
    assert np.allclose(got, want, atol=60 if isinstance(system, projections.Conical) else 0.02)  # the conical one has an older axis
    assert np.allclose(system.back(np, *got), there, atol=1e-9)


#: The same, of conformal projections of older ellipsoids; the first is in feet of the US survey.
FOOT, CLARKE = 1200 / 3937, (6378206.4, 1 / 294.978698214)
DEG = lambda d, m, s=0.0: d + m / 60 + s / 3600
CONFORMAL = [
    (projections.Conformal((20925832.16, CLARKE[1]), DEG(27, 50), -99.0, DEG(28, 23), DEG(30, 17), 2000000.0, 0.0), (-96.0, 28.5), (2963503.91, 254759.80), 0.02),
    (projections.Conformal(CLARKE, 18.0, -77.0, 18.0, 18.0, 250000.0, 150000.0), (-DEG(76, 56, 37.26), DEG(17, 55, 55.80)), (255966.58, 142493.51), 0.01),
    (projections.system(27700).inner, (0.5, 50.5), (577274.99, 69740.50), 0.01),
    (projections.system(27700).inner, (DEG(1, 43, 4.5177), DEG(52, 39, 27.2531)), (651409.903, 313177.270), 0.002),
    (projections.system(27700), (DEG(1, 42, 57.787), DEG(52, 39, 28.723)), (651409.903, 313177.270), 5.0),
]


@pytest.mark.parametrize("system,there,want,atol", CONFORMAL)
def test_published_examples_of_conformal_projections(system, there, want, atol):
    got = system.forward(np, *map(np.float64, there))
    assert np.allclose(got, want, rtol=0, atol=atol)
    assert np.allclose(system.back(np, *got), there, rtol=0, atol=1e-9 if not isinstance(system, projections.Shifted) else 1e-7)


def test_datums():
    wgs72 = (0.0, 0.0, 4.5, 0.0, 0.0, 0.554, 0.219)  # a published example of the step
    there = projections.helmert((3657660.66, 255768.55, 5201382.11), wgs72)
    assert np.allclose(there, (3657660.78, 255778.43, 5201387.75), rtol=0, atol=0.01)
    assert np.allclose(projections.helmert(there, wgs72, inverse=True), (3657660.66, 255768.55, 5201382.11), rtol=0, atol=0.001)
    rng = np.random.default_rng(3)
    lon, lat = rng.uniform(-180, 180, 200), rng.uniform(-90, 90, 200)
    got = projections.geodetic(np, *projections.geocentric(np, lon, lat, projections.AIRY), projections.AIRY)
    assert np.allclose(got, (lon, lat), rtol=0, atol=1e-11)


def test_zones_of_one_ellipsoid_equal_the_others():
    lon, lat = np.array([8.5, 10.0, 11.9]), np.array([48.0, 54.5, 0.0])
    assert np.allclose(crs.transform(lon, lat, 4326, 25832), crs.transform(lon, lat, 4326, 32632), rtol=0, atol=1e-3)
    assert np.allclose(projections.system(2193).forward(np, 173.0, 0.0), (1600000, 10000000))
    assert np.allclose(projections.system(2154).forward(np, 3.0, 46.5), (700000, 6600000), atol=1e-6)
    x, y = crs.transform(np.array([-179.0, 179.0]), np.array([-41.0, -41.0]), 4326, 2193)
    assert 0 < x[0] - x[1] < 200_000  # neighbours across the antimeridian
    x, y = crs.transform(np.array([-10.0]), np.array([40.0]), 4326, projections.MODIS)
    # the side of a tile of that grid, ten degrees, is published
    assert np.allclose((x[0], y[0]), (-1111950.5197665 * np.cos(np.radians(40)), 4 * 1111950.5197665), rtol=0, atol=1e-3)


def test_points_without_an_image_are_null(spark):
    df = spark.createDataFrame([(3.0, -90.0), (None, 5.0), (3.0, 46.5)], "lon double, lat double")
    x, y = crs.transform(F.col("lon"), F.col("lat"), 4326, 2154)
    assert [(r[0], r[1]) for r in df.select(F.round(x), F.round(y)).collect()] == [(None, None), (None, None), (700000.0, 6600000.0)]


#: All systems but the zones, of which one stands for all.
TRIED = [c for c in projections.SYSTEMS if c in (25832, 26910, 31467) or not (25800 <= c < 25900 or 26900 <= c < 27000 or 31464 < c < 31470)]


@pytest.mark.parametrize("epsg", TRIED)
def test_round_trips_on_numbers_and_columns(spark, epsg):
    kind, *_ = projections.SYSTEMS[epsg]
    s = projections.system(epsg)
    s = getattr(s, "inner", s)
    rng = np.random.default_rng(epsg)
    lat = s.pole * rng.uniform(55, 90, 50) if kind == "polar" else (s.lat0 if kind in ("azimuthal", "conical", "conformal") else 45.0) + rng.uniform(-15, 15, 50)
    lon = rng.uniform(-179, 179, 50) if kind == "polar" else s.lon0 + rng.uniform(*((-6, 6) if kind == "transverse" else (-20, 20)), 50)
    x, y = crs.transform(lon, lat, 4326, epsg)
    back = crs.transform(x, y, epsg, 4326)
    assert np.allclose(back[1], lat, atol=1e-8) and np.allclose((back[0] - crs.turned(lon) + 180) % 360 - 180, 0, atol=1e-6)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat, strict=True))], "i int, lon double, lat double")
    cx, cy = crs.transform(F.col("lon"), F.col("lat"), 4326, epsg)
    got = df.select("i", cx.alias("x"), cy.alias("y"))
    bx, by = crs.transform(F.col("x"), F.col("y"), epsg, 4326)
    rows = got.select("i", "x", "y", bx.alias("lon"), by.alias("lat")).orderBy("i").collect()
    assert np.allclose([r["x"] for r in rows], x, atol=1e-4) and np.allclose([r["y"] for r in rows], y, atol=1e-4)
    assert np.allclose([r["lat"] for r in rows], lat, atol=1e-8)


def test_steps_between_datums_are_short(spark, capsys):
    """a step made what it uses often anew for each use, up to some hundred times a point."""
    x, y = crs.transform(F.col("x"), F.col("y"), 4326, 27700)
    lon, lat = projections.system(27700).back(crs._Columns, F.col("x"), F.col("y"))
    for out in (x, y, lon, lat):
        spark.range(5).selectExpr("id - 5.0D AS x", "id + 50.0D AS y").select(out.alias("o")).explain()
        plan = capsys.readouterr().out.upper()
        assert 0 < sum(plan.count(f"{f}(") for f in ("SIN", "COS", "SINH", "COSH", "ATAN2", "SQRT")) <= 40, plan


def test_chained_columns_equal_numbers(spark):
    points = [(-5.0 + i / 7, 50.0 + i / 5) for i in range(40)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(40, None, 50.0), (41, 1.0, None)], "i int, lon double, lat double")
    for epsg in (27700, 31467):
        x, y = crs.transform(F.col("lon"), F.col("lat"), 4326, epsg)
        rows = df.select("i", x.alias("x"), y.alias("y")).orderBy("i").collect()
        want = crs.transform(*map(np.array, zip(*points, strict=True)), 4326, epsg)
        assert np.allclose([(r["x"], r["y"]) for r in rows[:40]], np.transpose(want), rtol=0, atol=1e-6)
        assert all(r["x"] is None and r["y"] is None for r in rows[40:])
    assert projections.chain((1.0, 2.0), []) == (1.0, 2.0)
