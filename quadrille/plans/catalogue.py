"""Registered queries of the raster operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs, geometry, grid, media, metadata, projections, values
from ..functions.grid import GridSpec
from ..operators import coords, joins, mosaic, reduce, render, select, show, warp
from ..sources import items as sources
from . import planner
from .views import AS, BL, PX, SC, SIDE, assets, blocks, pixels, scenes, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- mosaics, band maths, reductions -------------------------------------------------------------------------------


@query(f"WITH {PX} SELECT band, iy, ix, arg_max(v, ord) FILTER (WHERE v IS NOT NULL) AS v FROM px GROUP BY ALL")
def mosaic_last_valid(s, d):
    return mosaic.mosaic(pixels(s, d), ["band", "iy", "ix"], "ord")


@query(f"WITH {PX} SELECT band, iy, ix, arg_min(v, ord) FILTER (WHERE v IS NOT NULL) AS v FROM px GROUP BY ALL")
def mosaic_first_valid(s, d):
    return mosaic.mosaic(pixels(s, d), ["band", "iy", "ix"], "ord", reverse=True)


@query(f"WITH {PX} SELECT band, iy, ix, coalesce(arg_max(raw, ord) FILTER (WHERE raw <> 1), 1) AS v FROM px GROUP BY ALL")
def mosaic_custom_nodata(s, d):
    return mosaic.mosaic(pixels(s, d), ["band", "iy", "ix"], "ord", value="raw", nodata=1.0)


@query(f"WITH {PX} SELECT item, iy, ix, band, t, last_value(v IGNORE NULLS) OVER (PARTITION BY band, iy, ix ORDER BY ord ROWS UNBOUNDED PRECEDING) AS v FROM px")
def running_mosaic(s, d):
    return mosaic.running_mosaic(pixels(s, d), ["band", "iy", "ix"], ["ord"]).select("item", "iy", "ix", "band", "t", "v")


@query(f"WITH {PX}, b AS (SELECT iy, ix, avg(v) FILTER (band = 'A') AS nir, avg(v) FILTER (band = 'N') AS red FROM px WHERE band IN ('A', 'N') GROUP BY ALL) SELECT iy, ix, round((nir - red) / nullif(nir + red, 0), 9) AS ndvi FROM b")
def ndvi(s, d):
    wide = joins.align_bands(pixels(s, d), ["iy", "ix"], {"A": "nir", "N": "red"})
    return wide.select("iy", "ix", F.round(values.ratio(F.col("nir"), F.col("red")), 9).alias("ndvi"))


@query(f"WITH {PX} SELECT date_trunc('week', t)::TIMESTAMP + INTERVAL 6 DAY AS bucket, round(avg(v), 9) AS v FROM px GROUP BY ALL")
def weekly_mean(s, d):
    return reduce.resample(pixels(s, d), "1w", "mean").withColumn("v", F.round("v", 9))


@query(f"WITH {PX}, p AS (SELECT * FROM px WHERE month(t) <> 2), m AS (SELECT date_trunc('month', t)::TIMESTAMP AS bucket, band, median(v) AS v FROM p GROUP BY ALL), g AS (SELECT unnest(generate_series((SELECT min(bucket) FROM m), (SELECT max(bucket) FROM m), INTERVAL 1 MONTH)) AS bucket), bs AS (SELECT DISTINCT band FROM p) SELECT g.bucket, bs.band, m.v FROM g CROSS JOIN bs LEFT JOIN m ON m.bucket = g.bucket AND m.band = bs.band")
def monthly_median_gapfilled(s, d):
    p = pixels(s, d).filter(F.month("t") != 2)
    return reduce.resample(p, "MS", "median", by=["band"], gaps=True)


@query(f"WITH {PX}, {SC} SELECT band, count(v) AS n, round(avg(v), 9) AS mean FROM px WHERE item IN (SELECT id FROM scenes WHERE cloud < 40) GROUP BY ALL")
def low_cloud_items(s, d):
    p = select.where_items(pixels(s, d), scenes(s, d).withColumnRenamed("id", "item"), "cloud < 40", "item")
    return p.groupBy("band").agg(F.count("v").alias("n"), F.round(F.avg("v"), 9).alias("mean"))


@query(f"WITH {PX}, {SC}, p AS (SELECT px.* FROM px JOIN scenes ON id = item WHERE cloud < 40 AND band IN ('A', 'N')), b AS (SELECT t, iy, ix, avg(v) FILTER (band = 'A') AS nir, avg(v) FILTER (band = 'N') AS red FROM p GROUP BY ALL) SELECT date_trunc('week', t)::TIMESTAMP + INTERVAL 6 DAY AS bucket, round(avg((nir - red) / nullif(nir + red, 0)), 9) AS v FROM b GROUP BY ALL")
def weekly_ndvi_of_clear_items(s, d):
    p = select.where_items(pixels(s, d), scenes(s, d).withColumnRenamed("id", "item"), "cloud < 40", "item")
    wide = joins.align_bands(p, ["t", "iy", "ix"], {"A": "nir", "N": "red"})
    out = wide.select("t", values.ratio(F.col("nir"), F.col("red")).alias("v"))
    return reduce.resample(out, "1w", "mean").withColumn("v", F.round("v", 9))


@query(f"WITH {PX} SELECT band, min(v) AS lo, max(v) AS hi, round(avg(v), 9) AS mean, median(v) AS med FROM px WHERE iy BETWEEN 4 AND 12 AND ix BETWEEN 8 AND 20 GROUP BY ALL")
def aoi_stats(s, d):
    p = select.box(pixels(s, d), x=(8, 20), y=(12, 4), xcol="ix", ycol="iy")
    return p.groupBy("band").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.round(F.avg("v"), 9).alias("mean"), F.median("v").alias("med"))


@query(f"WITH {PX} SELECT band, count(*) AS n, count(DISTINCT t) AS dates FROM px WHERE t >= TIMESTAMP '1995-02-01' AND t < TIMESTAMP '1996-01-01' AND band IN ('A', 'R') GROUP BY ALL")
def time_and_band_slice(s, d):
    p = select.bands(select.between(pixels(s, d), "1995-02", "1995"), ["A", "R"])
    return p.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("dates"))


@query(f"WITH {PX}, m AS (SELECT avg(v) AS g FROM px), c AS (SELECT iy, ix, avg(v) AS v FROM px GROUP BY ALL) SELECT iy, ix, round(v - g, 9) AS anomaly FROM c, m")
def anomaly_vs_global_mean(s, d):
    p = pixels(s, d)
    cell = reduce.reduce(p, ["iy", "ix"], "mean")
    both = joins.with_global(cell, p, F.avg("v").alias("g"))
    return both.select("iy", "ix", F.round(F.col("v") - F.col("g"), 9).alias("anomaly"))


@query(f"WITH {PX} SELECT item, iy, ix, CASE WHEN v > 25 THEN v END AS v FROM px")
def where_mask(s, d):
    return select.where(pixels(s, d), F.col("v") > 25).select("item", "iy", "ix", "v")


@query(f"WITH {PX} SELECT count(*) AS n_pixels, count(DISTINCT item) AS n_items, count(DISTINCT band) AS n_bands FROM px")
def stack_counts(s, d):
    return pixels(s, d).agg(F.count(F.lit(1)).alias("n_pixels"), F.countDistinct("item").alias("n_items"), F.countDistinct("band").alias("n_bands"))


@query(f"WITH {PX} SELECT t, item, band, iy, ix, round(coalesce(nullif(raw, 7) * 0.5::DOUBLE + 3, -1), 9) AS v FROM px")
def rescale_mask_fill(s, d):
    v = values.fill(values.rescale(values.mask(F.col("raw"), 7.0), 0.5, 3.0), -1.0)
    return pixels(s, d).select("t", "item", "band", "iy", "ix", F.round(v, 9).alias("v"))


# --- grid arithmetic -----------------------------------------------------------------------------------------------

RES = 3.0


@query(f"WITH {SC} SELECT id, floor(minx / 3.0::DOUBLE) * 3.0::DOUBLE + 0.0 AS minx, floor(miny / 3.0::DOUBLE) * 3.0::DOUBLE + 0.0 AS miny, ceil(maxx / 3.0::DOUBLE) * 3.0::DOUBLE + 0.0 AS maxx, ceil(maxy / 3.0::DOUBLE) * 3.0::DOUBLE + 0.0 AS maxy FROM scenes")
def snapped_bounds(s, d):
    box = grid.snapped(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")], RES, RES)
    return scenes(s, d).select("id", *[(b + 0.0).alias(c) for b, c in zip(box, ("minx", "miny", "maxx", "maxy"), strict=True)])  # -0 becomes 0


@query(f"WITH {SC} SELECT id, floor((size / 1000 + 0.35::DOUBLE) / 0.7::DOUBLE)::INT AS width, floor((cloud + 1.25::DOUBLE) / 2.5::DOUBLE)::INT AS height FROM scenes")
def grid_shape(s, d):
    return scenes(s, d).select("id", grid.count_pixels(0.0, F.col("size") / 1000, 0.7).alias("width"), grid.count_pixels(0.0, F.col("cloud"), 2.5).alias("height"))


def _coords(s, d, anchor):
    x = grid.pixel_x(F.col("ix"), -100.0, 50.5, SIDE, 4.7, anchor)
    y = grid.pixel_y(F.col("iy"), 10.0, 75.25, SIDE, 2.04, anchor)
    return pixels(s, d).select("iy", "ix").distinct().select("iy", "ix", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"))


@query(f"WITH {PX} SELECT DISTINCT iy, ix, round(-100 + ix * (150.5::DOUBLE / 32), 9) AS x, round(75.25::DOUBLE - iy * (65.25::DOUBLE / 32), 9) AS y FROM px")
def pixel_coords_topleft(s, d):
    return _coords(s, d, "topleft")


@query(f"WITH {PX} SELECT DISTINCT iy, ix, round(-100 + ix * (150.5::DOUBLE / 32) + 2.35::DOUBLE, 9) AS x, round(75.25::DOUBLE - iy * (65.25::DOUBLE / 32) - 1.02::DOUBLE, 9) AS y FROM px")
def pixel_coords_center(s, d):
    return _coords(s, d, "center")


@query(f"WITH {SC} SELECT cloud, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM scenes GROUP BY ALL")
def union_bounds(s, d):
    return scenes(s, d).groupBy("cloud").agg(*planner.union_box())


@query(f"WITH {SC} SELECT id, minx, miny FROM scenes WHERE minx < 20 AND maxx > -30 AND miny < 40 AND maxy > -5")
def bounds_overlap_filter(s, d):
    hit = grid.overlaps([F.col(c) for c in ("minx", "miny", "maxx", "maxy")], (-30.0, -5.0, 20.0, 40.0))
    return scenes(s, d).filter(hit).select("id", "minx", "miny")


AREAS = """v AS (SELECT n_nationkey AS area, (n_nationkey * 37 % 300 - 150)::DOUBLE AS cx, (n_nationkey * 23 % 120 - 60)::DOUBLE AS cy, [[-20, -10], [20, -12], [15, 10], [0, 2.5], [-18, 11]]::DOUBLE[][] AS p FROM nation),
  e AS (SELECT area, cx + p[i][1] AS x0, cy + p[i][2] AS y0, cx + p[i % 5 + 1][1] AS x1, cy + p[i % 5 + 1][2] AS y1 FROM v, range(1, 6) AS t(i)),
  hit AS (SELECT area, id, bool_or(least(x0, x1) <= maxx AND greatest(x0, x1) >= minx AND least(y0, y1) <= maxy AND greatest(y0, y1) >= miny
    AND least((x1 - x0) * (miny - y0) - (y1 - y0) * (minx - x0), (x1 - x0) * (maxy - y0) - (y1 - y0) * (minx - x0), (x1 - x0) * (miny - y0) - (y1 - y0) * (maxx - x0), (x1 - x0) * (maxy - y0) - (y1 - y0) * (maxx - x0)) <= 0
    AND greatest((x1 - x0) * (miny - y0) - (y1 - y0) * (minx - x0), (x1 - x0) * (maxy - y0) - (y1 - y0) * (minx - x0), (x1 - x0) * (miny - y0) - (y1 - y0) * (maxx - x0), (x1 - x0) * (maxy - y0) - (y1 - y0) * (maxx - x0)) >= 0) AS edge,
    count(*) FILTER ((y0 > miny) <> (y1 > miny) AND minx < x0 + (x1 - x0) * (miny - y0) / (y1 - y0)) % 2 = 1 AS corner FROM scenes, e GROUP BY area, id)"""


@query(f"WITH {SC}, {AREAS} SELECT area, id FROM hit WHERE edge OR corner")
def catalogue_search_areas(s, d):
    """Every scene that shares a point with one of many polygons, an area a nation."""
    n = F.col("n_nationkey")
    cx, cy = n * 37 % 300 - 150, n * 23 % 120 - 60
    ring = F.array(*[F.array((cx + x).cast("double"), (cy + y).cast("double")) for x, y in ((-20, -10), (20, -12), (15, 10), (0, 2.5), (-18, 11))])
    areas = table(s, d, "nation").select(n.alias("area"), geometry.edges_of_ring(ring).alias("edges"))
    return select.search_areas(scenes(s, d), areas, cell=5.0).select("area", "id")


@query(f"WITH {SC} SELECT id, minx, miny, maxx, maxy, cloud FROM scenes WHERE minx <= 0.5 AND maxx >= 0.5 AND miny <= 5.0 AND maxy >= 5.0")
def catalogue_search_point(s, d):
    return select.search(scenes(s, d), point=(0.5, 5.0), time="dt").select("id", "minx", "miny", "maxx", "maxy", "cloud")


@query(f"WITH {SC} SELECT id, dt FROM scenes WHERE minx <= 12 AND maxx >= 0 AND miny <= 9 AND maxy >= 0 AND dt >= TIMESTAMP '1996-01-01' AND dt < TIMESTAMP '1998-01-01' AND epsg::VARCHAR IN ('32613')")
def catalogue_search_box(s, d):
    found = select.search(scenes(s, d).withColumn("collection", F.col("epsg").cast("string")), bbox=(0.0, 0.0, 12.0, 9.0), collections=["32613"], start="1996", end="1997", time="dt")
    return found.select("id", "dt")


@query(f"WITH {SC} SELECT id, (minx + 180) / 0.25::DOUBLE AS col_off, (80 - maxy) / 0.5::DOUBLE AS row_off, (maxx - minx) / 0.25::DOUBLE AS w, (maxy - miny) / 0.5::DOUBLE AS h FROM scenes")
def asset_windows(s, d):
    return _windows(s, d, 0.25, 0.5).select("id", "col_off", "row_off", "w", "h")


def _windows(s, d, xres, yres):
    box = [F.col(c) for c in ("minx", "miny", "maxx", "maxy")]
    names = ("col_off", "row_off", "w", "h")
    return scenes(s, d).select("id", *[c.alias(n) for c, n in zip(grid.window_of(box, -180.0, 80.0, xres, yres), names, strict=True)])


@query(f"WITH {SC}, w AS (SELECT id, (minx + 180) / 0.3::DOUBLE AS c0, (80 - maxy) / 0.3::DOUBLE AS r0, 1 / 0.3::DOUBLE AS n FROM scenes), cx AS (SELECT unnest(range(38))::INT AS cx), cy AS (SELECT unnest(range(17))::INT AS cy) SELECT id, cy, cx FROM w, cx, cy WHERE c0 < least((cx + 1) * 32, 1200) AND c0 + n > cx * 32 AND r0 < least((cy + 1) * 32, 533) AND r0 + n > cy * 32")
def chunk_asset_join(s, d):
    w = _windows(s, d, 0.3, 0.3)
    w = w.withColumn("w", F.lit(1 / 0.3)).withColumn("h", F.lit(1 / 0.3))
    return joins.chunks_of(w, (533, 1200), (32, 32)).select("id", "cy", "cx")


@query(f"WITH {PX}, g AS (SELECT b.band, unnest(range(36))::INT AS iy FROM (SELECT DISTINCT band FROM px) b), gg AS (SELECT band, iy, unnest(range(34))::INT AS ix FROM g), m AS (SELECT band, iy, ix, max(v) AS v FROM px GROUP BY ALL) SELECT gg.band, gg.iy, gg.ix, coalesce(v, -9999) AS v FROM gg LEFT JOIN m ON m.band = gg.band AND m.iy = gg.iy AND m.ix = gg.ix")
def densify_fill(s, d):
    p = pixels(s, d)
    return joins.densify(reduce.reduce(p, ["band", "iy", "ix"], "max"), p.select("band").distinct(), (36, 34), ["band"], -9999.0)


@query(f"WITH {SC}, o AS (SELECT cloud, minx, lead(minx) OVER (PARTITION BY cloud ORDER BY dt, id) AS nxt FROM scenes) SELECT cloud, coalesce(bool_and(nxt > minx), true) AS increasing, coalesce(bool_and(nxt < minx), true) AS decreasing FROM o GROUP BY ALL")
def monotonic_check(s, d):
    return coords.monotonic(scenes(s, d), ["cloud"], "minx", ["dt", "id"])


@query(f"WITH {PX}, c AS (SELECT band, ix * 2.5::DOUBLE - 7 AS x, 90 - iy * 1.5::DOUBLE AS y FROM px), x AS (SELECT band, min(x) AS lo, max(x) AS hi, count(DISTINCT x) AS n FROM c GROUP BY ALL), y AS (SELECT band, min(y) AS lo, max(y) AS hi, count(DISTINCT y) AS n FROM c GROUP BY ALL) SELECT band, x.lo AS minx, y.lo - (y.hi - y.lo) / (y.n - 1) AS miny, x.hi + (x.hi - x.lo) / (x.n - 1) AS maxx, y.hi AS maxy FROM x JOIN y USING (band)")
def array_bounds(s, d):
    c = pixels(s, d).select("band", (F.col("ix") * 2.5 - 7).alias("x"), (90 - F.col("iy") * 1.5).alias("y"))
    return coords.array_bounds(c, ["band"])


# --- coordinate systems and tiles ----------------------------------------------------------------------------------


@query(f"WITH {SC} SELECT id, round(6378137.0::DOUBLE * radians(minx), 4) + 0.0 AS x, round(6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(miny) / 2)), 4) + 0.0 AS y FROM scenes")
def lonlat_to_mercator(s, d):
    x, y = crs.transform(F.col("minx"), F.col("miny"), 4326, 3857)
    return scenes(s, d).select("id", (F.round(x, 4) + 0.0).alias("x"), (F.round(y, 4) + 0.0).alias("y"))  # -0 becomes 0


@query(f"WITH {SC} SELECT id, round(degrees(minx * 1e5::DOUBLE / 6378137.0::DOUBLE), 8) AS lon, round(degrees(2 * atan(exp(miny * 1e5::DOUBLE / 6378137.0::DOUBLE)) - pi() / 2), 8) AS lat FROM scenes")
def mercator_to_lonlat(s, d):
    x, y = crs.transform(F.col("minx") * 1e5, F.col("miny") * 1e5, 3857, 4326)
    return scenes(s, d).select("id", F.round(x, 8).alias("lon"), F.round(y, 8).alias("lat"))


def utm_sql(lon: str, lat: str) -> tuple[str, str, str]:
    """CTE steps, easting and northing in zone 13 north, for the oracle."""
    c = f"{crs.C!r}::DOUBLE"
    steps = f"u1 AS (SELECT *, sinh(atanh(sin(radians({lat}))) - {c} * atanh({c} * sin(radians({lat})))) AS ut, radians({lon} + 105) AS ud FROM u0), u2 AS (SELECT *, atan2(ut, cos(ud)) AS xi, atanh(sin(ud) / sqrt(1 + ut * ut)) AS eta FROM u1)"
    east = " + ".join(["eta"] + [f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(crs.ALPHA, 1)])
    north = " + ".join(["xi"] + [f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(crs.ALPHA, 1)])
    k = f"{crs.K0 * crs.AREA!r}::DOUBLE"
    return steps, f"(5e5::DOUBLE + {k} * ({east}))", f"({k} * ({north}))"


_STEPS, _EAST, _NORTH = utm_sql("lon", "lat")


@query(f"WITH {SC}, u0 AS (SELECT id, -105 + minx / 100 AS lon, miny AS lat FROM scenes), {_STEPS} SELECT id, round({_EAST}, 3) AS x, round({_NORTH}, 3) AS y FROM u2")
def lonlat_to_utm(s, d):
    x, y = crs.transform(F.col("minx") / 100 - 105, F.col("miny"), 4326, 32613)
    return scenes(s, d).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def lambert_sql(lon: str, lat: str) -> tuple[str, str]:
    """Easting and northing in EPSG:2154 by the tangents of half angles, for the oracle."""
    e, n0, n1, n2 = "0.08181919104281579::DOUBLE", "46.5", "49.0", "44.0"
    t = lambda p: f"(tan(pi() / 4 - radians({p}) / 2) / pow((1 - {e} * sin(radians({p}))) / (1 + {e} * sin(radians({p}))), {e} / 2))"
    m = lambda p: f"(cos(radians({p})) / sqrt(1 - pow({e} * sin(radians({p})), 2)))"
    n = f"((ln({m(n1)}) - ln({m(n2)})) / (ln({t(n1)}) - ln({t(n2)})))"
    r = lambda p: f"(6378137.0::DOUBLE * {m(n1)} / ({n} * pow({t(n1)}, {n})) * pow({t(p)}, {n}))"
    turn = f"({n} * radians({lon} - 3))"
    return f"(700000 + {r(lat)} * sin({turn}))", f"(6600000 + {r(n0)} - {r(lat)} * cos({turn}))"


_LX, _LY = lambert_sql("lon", "lat")


@query(f"WITH {SC}, u0 AS (SELECT id, minx / 20 AS lon, miny / 4 + 45 AS lat FROM scenes) SELECT id, round({_LX}, 3) AS x, round({_LY}, 3) AS y, round(6371007.181::DOUBLE * radians(lon) * cos(radians(lat)), 3) + 0.0 AS sx, round(6371007.181::DOUBLE * radians(lat), 3) AS sy FROM u0")
def lonlat_to_lambert_and_sinusoidal(s, d):
    lon, lat = F.col("minx") / 20, F.col("miny") / 4 + 45
    x, y = crs.transform(lon, lat, 4326, 2154)
    sx, sy = crs.transform(lon, lat, 4326, projections.MODIS)
    return scenes(s, d).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), (F.round(sx, 3) + 0.0).alias("sx"), F.round(sy, 3).alias("sy"))


@query(f"WITH {SC} SELECT id, round(-5 + minx / 60, 7) AS lon, round(54 + miny / 20, 7) AS lat FROM scenes")
def old_datum_round_trip(s, d):
    """To the British grid, on an older ellipsoid and datum, and back."""
    x, y = crs.transform(F.col("minx") / 60 - 5, F.col("miny") / 20 + 54, 4326, 27700)
    lon, lat = crs.transform(F.col("x"), F.col("y"), 27700, 4326)
    return scenes(s, d).select("id", x.alias("x"), y.alias("y")).select("id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query(f"WITH {SC}, u0 AS (SELECT id, minx / 100 - 105 AS lon, miny AS lat FROM scenes) SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM u0")
def utm_round_trip(s, d):
    x, y = crs.transform(F.col("minx") / 100 - 105, F.col("miny"), 4326, 32613)
    lon, lat = crs.transform(F.col("x"), F.col("y"), 32613, 4326)
    return scenes(s, d).select("id", x.alias("x"), y.alias("y")).select("id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(f"WITH {SC}, u00 AS (SELECT id, minx / 100 - 105 AS x0, maxx / 100 - 105 AS x1, miny AS y0, maxy AS y1 FROM scenes), u0 AS (SELECT id, unnest([x0, x0, x1, x1]) AS lon, unnest([y0, y1, y1, y0]) AS lat FROM u00), {_STEPS} SELECT id, round(min({_EAST}), 3) AS minx, round(min({_NORTH}), 3) AS miny, round(max({_EAST}), 3) AS maxx, round(max({_NORTH}), 3) AS maxy FROM u2 GROUP BY ALL")
def reproject_bounds(s, d):
    box = crs.reproject_bounds([F.col("minx") / 100 - 105, F.col("miny"), F.col("maxx") / 100 - 105, F.col("maxy")], 4326, 32613)
    return scenes(s, d).select("id", *[F.round(b, 3).alias(c) for b, c in zip(box, ("minx", "miny", "maxx", "maxy"), strict=True)])


@query(f"WITH {SC} SELECT id, least(a * 0 + x, a * 10 + x, a * 10 + b * 20 + x, b * 20 + x) AS minx, least(y, y + e * 20, y + dd * 10, y + dd * 10 + e * 20) AS miny, greatest(x, a * 10 + x, a * 10 + b * 20 + x, b * 20 + x) AS maxx, greatest(y, y + e * 20, y + dd * 10, y + dd * 10 + e * 20) AS maxy FROM (SELECT id, 1.5::DOUBLE AS a, cloud / 64::DOUBLE AS b, minx AS x, cloud / 32::DOUBLE AS dd, -2.0::DOUBLE AS e, maxy AS y FROM scenes)")
def bounds_from_affine(s, d):
    a = [F.lit(1.5), F.col("cloud") / 64.0, F.col("minx"), F.col("cloud") / 32.0, F.lit(-2.0), F.col("maxy")]
    box = crs.affine_bounds(a, F.lit(20), F.lit(10), 4326, 4326)
    return scenes(s, d).select("id", *[b.alias(c) for b, c in zip(box, ("minx", "miny", "maxx", "maxy"), strict=True)])


@query(f"WITH {SC}, z AS (SELECT id, cloud % 12 AS z, 2 * pi() * 6378137.0::DOUBLE / pow(2.0::DOUBLE, cloud % 12) AS size, minx, miny FROM scenes), m AS (SELECT *, radians(minx) * 6378137.0::DOUBLE / (2 * pi() * 6378137.0::DOUBLE) + 0.5 AS fx, 0.5 - ln(tan(pi() / 4 + radians(miny) / 2)) * 6378137.0::DOUBLE / (2 * pi() * 6378137.0::DOUBLE) AS fy FROM z), t AS (SELECT *, greatest(0, least(floor(fx * pow(2.0::DOUBLE, z)), pow(2.0::DOUBLE, z) - 1))::INT AS x, greatest(0, least(floor(fy * pow(2.0::DOUBLE, z)), pow(2.0::DOUBLE, z) - 1))::INT AS y FROM m) SELECT id, z, x, y, round(x * size - pi() * 6378137.0::DOUBLE, 4) AS minx, round(pi() * 6378137.0::DOUBLE - (y + 1) * size, 4) AS miny FROM t")
def xyz_tile_bounds(s, d):
    z = F.col("cloud") % 12
    x, y = crs.tile_of(F.col("minx"), F.col("miny"), z)
    t = scenes(s, d).select("id", z.cast("int").alias("z"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    a, b, _, _ = crs.tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    return t.select("id", "z", "x", "y", F.round(a, 4).alias("minx"), F.round(b, 4).alias("miny"))


@query(f"WITH {SC}, b AS (SELECT id, cloud % 6 AS z, pow(2, cloud % 6) AS n, minx, miny, maxx, maxy FROM scenes), f AS (SELECT id, z, n, minx / 360.0::DOUBLE + 0.5 AS x0, maxx / 360.0::DOUBLE + 0.5 AS x1, 0.5 - ln(tan(pi() / 4 + radians(maxy) / 2)) / (2 * pi()) AS y0, 0.5 - ln(tan(pi() / 4 + radians(miny) / 2)) / (2 * pi()) AS y1 FROM b), t AS (SELECT id, z, greatest(0, least(floor(x0 * n - 1e-9), n - 1))::INT AS a, greatest(0, least(floor(x1 * n - 1e-9), n - 1))::INT AS b, greatest(0, least(floor(y0 * n), n - 1))::INT AS c, greatest(0, least(floor(y1 * n), n - 1))::INT AS d FROM f), u AS (SELECT id, z, unnest(range(a, b + 1))::INT AS x, c, d FROM t) SELECT id, z, x, unnest(range(c, d + 1))::INT AS y FROM u")
def tiles_of_bounds(s, d):
    box = [F.col(c) for c in ("minx", "miny", "maxx", "maxy")]
    return show.tiles_of_bounds(scenes(s, d), box, F.col("cloud") % 6).select("id", "z", "x", "y")


@query(f"WITH {SC} SELECT id, ceil(log2(40075016.686::DOUBLE * cos(radians(miny)) * 800 / (256 * size)))::INT AS zoom FROM scenes")
def auto_zoom(s, d):
    return scenes(s, d).select("id", crs.auto_zoom(F.col("miny"), F.col("size")).alias("zoom"))


# --- catalogue planning --------------------------------------------------------------------------------------------


def _sorted(s, d, ascending):
    key = F.coalesce(F.when(F.col("cloud") > 5, F.date_format("dt", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit(""))
    items = scenes(s, d).select(F.col("id").alias("item_idx"), F.create_map(F.lit("datetime"), key).alias("properties"))
    return sources.ordered(items, "asc" if ascending else "desc").select(F.col("item_idx").alias("id"), "time_idx")


_KEY = "coalesce(CASE WHEN cloud > 5 THEN strftime(dt, '%Y-%m-%dT%H:%M:%SZ') END, '')"


@query(f"WITH {SC} SELECT id, (row_number() OVER (ORDER BY {_KEY}, id) - 1)::INT AS time_idx FROM scenes")
def sortby_date_asc(s, d):
    return _sorted(s, d, True)


@query(f"WITH {SC} SELECT id, (row_number() OVER (ORDER BY {_KEY} DESC, id) - 1)::INT AS time_idx FROM scenes")
def sortby_date_desc(s, d):
    return _sorted(s, d, False)


@query(f"WITH {AS}, n AS (SELECT item, count(DISTINCT asset) AS k FROM assets GROUP BY ALL), b AS (SELECT arg_max(item, row(k, -item)) AS item FROM n) SELECT asset, min(ordinal) AS first  FROM assets WHERE item = (SELECT item FROM b) GROUP BY ALL")
def assets_of_fullest_item(s, d):
    a = assets(s, d)
    n = a.groupBy("item").agg(F.countDistinct("asset").alias("k"))
    best = n.agg(F.max_by("item", F.struct("k", -F.col("item"))).alias("item"))
    return a.join(F.broadcast(best), "item").groupBy("asset").agg(F.min("ordinal").alias("first"))


@query(f"WITH {AS} SELECT ordinal, split_part(split_part(type, ';', 1), '/', 1) AS type, nullif(split_part(trim(split_part(type, ';', 1)), '/', 2), '') AS subtype, CASE WHEN type IS NULL THEN NULL WHEN contains(type, ';') THEN 1 ELSE 0 END AS n_params FROM assets")
def mimetype_parse(s, d):
    p = media.parse_type(F.col("type"))
    a = assets(s, d).select("ordinal", p.alias("p"))
    return a.select("ordinal", F.col("p.type").alias("type"), F.col("p.subtype").alias("subtype"), F.when(F.col("p").isNotNull(), F.size("p.params")).alias("n_params"))


@query(f"WITH {AS} SELECT asset, count(DISTINCT type) AS n_types, min(ordinal) AS first FROM assets GROUP BY ALL HAVING count(type) > 0 AND bool_and(type IN ('image/tiff; application=geotiff', 'image/tiff', 'image/jp2')) FILTER (WHERE type IS NOT NULL)")
def mimetype_filter(s, d):
    return metadata.select_by_type(assets(s, d), media.RASTER_TYPES).select("asset", "n_types", "first")


@query(f"WITH {SC} SELECT count(DISTINCT epsg) AS n_epsg, arg_min(epsg, id) AS first_epsg, min(id) FILTER (WHERE epsg <> (SELECT arg_min(epsg, id) FROM scenes)) AS first_conflict FROM scenes")
def crs_consensus(s, d):
    x = scenes(s, d)
    first = x.agg(F.min_by("epsg", "id").alias("first_epsg"))
    both = x.join(F.broadcast(first))
    return both.agg(F.countDistinct("epsg").alias("n_epsg"), F.min("first_epsg").alias("first_epsg"), F.min(F.when(F.col("epsg") != F.col("first_epsg"), F.col("id"))).alias("first_conflict"))


@query(f"WITH {SC} SELECT epsg, min(abs(cloud + 1.5::DOUBLE)) AS xres, min(abs(-(size / 1e4::DOUBLE))) AS yres FROM scenes GROUP BY ALL")
def finest_resolution(s, d):
    return scenes(s, d).select("epsg", (F.col("cloud") + 1.5).alias("x"), (-(F.col("size") / 1e4)).alias("y")).groupBy("epsg").agg(*planner.finest("x", "y"))


@query(f"WITH {SC}, p AS (SELECT id, CASE WHEN cloud % 3 = 0 THEN minx END AS pb, CASE WHEN cloud % 2 = 0 THEN minx + 0.5 END AS st, CASE WHEN cloud % 5 <> 0 THEN minx - 0.5 END AS ll FROM scenes) SELECT id, coalesce(pb, st, ll) AS minx, CASE WHEN pb IS NOT NULL THEN 'proj:bbox' WHEN st IS NOT NULL THEN 'shape+transform' WHEN ll IS NOT NULL THEN 'bbox' END AS origin FROM p")
def bbox_priority(s, d):
    x = scenes(s, d)
    options = [("proj:bbox", F.when(F.col("cloud") % 3 == 0, F.col("minx"))), ("shape+transform", F.when(F.col("cloud") % 2 == 0, F.col("minx") + 0.5)), ("bbox", F.when(F.col("cloud") % 5 != 0, F.col("minx") - 0.5))]
    best, origin = metadata.first_known(options)
    return x.select("id", best.alias("minx"), origin.alias("origin"))


@query(f"WITH {AS}, k AS (SELECT DISTINCT item, asset FROM assets WHERE value > 120), t AS (SELECT item, dense_rank() OVER (ORDER BY item)::INT - 1 AS time_idx FROM (SELECT DISTINCT item FROM k)), b AS (SELECT asset, dense_rank() OVER (ORDER BY asset)::INT - 1 AS band_idx FROM (SELECT DISTINCT asset FROM k)) SELECT item, asset, time_idx, band_idx FROM k JOIN t USING (item) JOIN b USING (asset)")
def drop_all_missing(s, d):
    k = assets(s, d).filter("value > 120").select("item", "asset").distinct()
    return metadata.reindex(metadata.reindex(k, "item", "time_idx"), "asset", "band_idx").select("item", "asset", "time_idx", "band_idx")


@query(f"WITH {AS}, i AS (SELECT DISTINCT item FROM assets), a AS (SELECT DISTINCT asset FROM assets WHERE asset <> 'error'), f AS (SELECT item, asset, arg_min(href, ordinal) AS url, arg_min(scale, ordinal) AS scale FROM assets GROUP BY ALL) SELECT i.item, a.asset, f.url, f.scale FROM i CROSS JOIN a LEFT JOIN f ON f.item = i.item AND f.asset = a.asset")
def item_asset_table(s, d):
    a = assets(s, d)
    names = a.filter("asset <> 'error'").select("asset").distinct()
    cells = a.groupBy("item", "asset").agg(F.min_by("href", "ordinal").alias("url"), F.min_by("scale", "ordinal").alias("scale"))
    return a.select("item").distinct().crossJoin(F.broadcast(names)).join(cells, ["item", "asset"], "left")


# --- metadata ------------------------------------------------------------------------------------------------------

_LONG = "SELECT l_returnflag AS grp, l_orderkey * 8 + l_linenumber AS item, unnest(['flag', 'status', 'mode', 'rare']) AS key, unnest([l_returnflag, l_linestatus, CASE WHEN l_quantity > 3 THEN 'x' END, CASE WHEN l_linenumber = 2 THEN 'only' END]) AS value, unnest([true, true, l_quantity > 1, l_linenumber = 2]) AS there FROM lineitem"


def _long(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet")
    kv = [("flag", F.col("l_returnflag"), F.lit(True)), ("status", F.col("l_linestatus"), F.lit(True)), ("mode", F.when(F.col("l_quantity") > 3, F.lit("x")), F.col("l_quantity") > 1), ("rare", F.when(F.col("l_linenumber") == 2, F.lit("only")), F.col("l_linenumber") == 2)]
    fields = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value"), t.alias("there")) for k, v, t in kv])
    return li.select(F.col("l_returnflag").alias("grp"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item"), F.explode(fields).alias("f")).select("grp", "item", "f.*").filter("there").drop("there")


@query(f"WITH m AS ({_LONG}), n AS (SELECT grp, count(DISTINCT item) AS items FROM m GROUP BY ALL), f AS (SELECT grp, key, count(DISTINCT item) AS have, count(DISTINCT value) AS k, count(value) AS nn, count(*) AS n, min(value) AS v FROM m WHERE there GROUP BY ALL) SELECT grp, key, have = items AND (k = 1 AND nn = n OR nn = 0) AS is_constant, CASE WHEN have = items AND k = 1 AND nn = n THEN v END AS value FROM f JOIN n USING (grp)")
def metadata_constant_fields(s, d):
    return metadata.constants(_long(s, d), ["grp"])


@query(f"WITH m AS ({_LONG}) SELECT grp, key, min(value) AS value FROM m WHERE there GROUP BY ALL HAVING count(DISTINCT value) = 1 AND bool_and(value IS NOT NULL)")
def metadata_all_same(s, d):
    return metadata.all_same(_long(s, d), ["grp"])


@query("SELECT event_id, (strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' ELSE '-05:30' END)::TIMESTAMPTZ::TIMESTAMP AS t FROM events WHERE event_id % 4 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 0")
def iso_datetime_to_utc(s, d):
    zone = F.element_at(F.array(F.lit("Z"), F.lit("+02:00"), F.lit("-05:30")), (F.col("event_id") % 3).cast("int") + 1)
    text = F.when(F.col("event_id") % 4 != 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone))
    return s.read.parquet(f"{d}/events.parquet").select("event_id", metadata.utc(text).alias("t"))


@query("SELECT event_id, CASE WHEN k % 3 = 1 THEN 'nir' END AS common_name, CASE WHEN k % 3 = 1 THEN k / 100.0::DOUBLE END AS center_wavelength FROM (SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events)")
def eo_bands_unpack(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    band = F.to_json(F.struct(F.lit("B8").alias("name"), F.lit("nir").alias("common_name"), (k / 100.0).alias("center_wavelength")))
    bands = F.concat(F.lit("["), F.array_join(F.array_repeat(band, k % 3), ","), F.lit("]"))
    e = metadata.eo_band(bands)
    return s.read.parquet(f"{d}/events.parquet").select("event_id", e["common_name"].alias("common_name"), e["center_wavelength"].alias("center_wavelength"))


# --- blocks --------------------------------------------------------------------------------------------------------


@query(f"WITH {BL}, e AS (SELECT time_idx, band, unnest(range(len(data))) AS p, unnest(data) AS v FROM blocks) SELECT time_idx, band, (p // 8)::INT AS iy, (p % 8)::INT AS ix, round(v::DOUBLE, 6) AS v FROM e")
def block_explode(s, d):
    return joins.explode_blocks(blocks(s, d), 8).withColumn("v", F.round(F.col("v").cast("double"), 6))


@query(f"WITH {BL}, e AS (SELECT time_idx, band, unnest(range(len(data))) AS p, unnest(data) AS v FROM blocks), m AS (SELECT band, p, arg_max(v, time_idx) FILTER (WHERE v > 0.05) AS v FROM e GROUP BY ALL) SELECT band, (p // 8)::INT AS iy, (p % 8)::INT AS ix, round(v::DOUBLE, 6) AS v FROM m")
def block_mosaic(s, d):
    b = blocks(s, d).withColumn("data", F.transform("data", lambda v: F.when(v > F.lit(0.05).cast("double"), v)))
    return joins.explode_blocks(mosaic.mosaic_blocks(b, ["band"], "time_idx"), 8).withColumn("v", F.round(F.col("v").cast("double"), 6))


@query("WITH cell AS (SELECT s_nationkey AS band, s_suppkey AS k, p, (s_suppkey * 7 + p)::DOUBLE AS v FROM supplier, range(65536) AS t(p) WHERE p >= s_suppkey * 4099 % 65536 AND s_suppkey % 17 <> 3), top AS (SELECT band, p, arg_max(v, k) AS v FROM cell GROUP BY ALL) SELECT band, count(*) AS n_valid, sum(v) AS total, sum(v * (p % 97)) AS weighed FROM top GROUP BY band")
def block_mosaic_256(s, d):
    """Blocks of 256 x 256 pixels, one a supplier, each missing up to a row of its own; digests of values and places."""
    k = F.col("s_suppkey")
    begin = (k * 4099 % 65536).cast("int")
    data = F.concat(F.array_repeat(F.lit(None).cast("double"), begin), F.sequence(k * 7 + begin, k * 7 + 65535).cast("array<double>"))
    data = F.when(k % 17 != 3, data)
    few = mosaic.dealt_layers(table(s, d, "supplier").select("s_nationkey", "s_suppkey"), ["s_nationkey"], "s_suppkey", 65536)
    blocks_ = few.select(F.col("s_nationkey").alias("band"), k.alias("k"), data.alias("data"))
    px = mosaic.mosaic_blocks(blocks_, ["band"], "k").select("band", F.posexplode("data").alias("p", "v")).filter("v IS NOT NULL")
    return px.groupBy("band").agg(F.count(F.lit(1)).alias("n_valid"), F.sum("v").alias("total"), F.sum(F.col("v") * (F.col("p") % 97)).alias("weighed"))


@query(f"WITH {PX} SELECT band, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.98) AS p98 FROM px GROUP BY band")
def band_quantiles(s, d):
    """Exact quantiles of whole bands, by distributed selection."""
    q = reduce.quantiles(pixels(s, d), [0.25, 0.5, 0.98], ["band"])
    of = lambda x: F.max(F.when(F.col("q") == x, F.col("v")))
    return q.groupBy("band").agg(of(0.25).alias("q1"), of(0.5).alias("median"), of(0.98).alias("p98"))



# --- resampling ----------------------------------------------------------------------------------------------------

SOURCE = GridSpec(32613, (400000.0, 3900000.0, 400000.0 + 320.0, 3900000.0 + 320.0), (10.0, 10.0))
SAME = GridSpec(32613, (399990.0, 3900010.0, 400250.0, 3900300.0), (6.5, 7.25))
_CELL = f"{PX}, c AS (SELECT band, iy, ix, arg_max(v, ord) FILTER (WHERE v IS NOT NULL AND iy + ix <> 9) AS v FROM px GROUP BY ALL)"
_OUT = "o AS (SELECT b.band, oy.iy, ox.ix FROM (SELECT DISTINCT band FROM px) b, (SELECT unnest(range(40))::INT AS iy) oy, (SELECT unnest(range(40))::INT AS ix) ox), q AS (SELECT *, (399990 + ix * 6.5::DOUBLE - 400000) / 10 AS fx, (3900320 - (3900300 - iy * 7.25::DOUBLE)) / 10 AS fy FROM o)"


def _cells(s, d):
    p = pixels(s, d).withColumn("v", F.when(F.col("iy") + F.col("ix") != 9, F.col("v")))
    return mosaic.mosaic(p, ["band", "iy", "ix"], "ord")


def _layers(s, d):
    return pixels(s, d).select("band").distinct()


@query(f"WITH {_CELL}, {_OUT} SELECT q.band, q.iy, q.ix, c.v FROM q LEFT JOIN c ON c.band = q.band AND fx BETWEEN 0 AND 31 AND fy BETWEEN 0 AND 31 AND c.ix = ceil(fx - 0.5) AND c.iy = floor(fy + 0.5)")
def interp_nearest_same_crs(s, d):
    return warp.reproject(_cells(s, d), SOURCE, SAME, _layers(s, d), ["band"], "nearest")


@query(f"WITH {_CELL}, {_OUT}, i AS (SELECT *, least(floor(fx), 30) AS i, least(floor(fy), 30) AS k FROM q WHERE fx BETWEEN 0 AND 31 AND fy BETWEEN 0 AND 31), w AS (SELECT i.band, i.iy, i.ix, count(*) AS n, sum(c.v * (1 - abs(fx - c.ix)) * (1 - abs(fy - c.iy))) AS s, count(c.v) AS nn FROM i JOIN c ON c.band = i.band AND c.ix IN (i.i, i.i + 1) AND c.iy IN (i.k, i.k + 1) GROUP BY ALL) SELECT q.band, q.iy, q.ix, round(CASE WHEN nn = 4 THEN s END, 6) AS v FROM q LEFT JOIN w ON w.band = q.band AND w.iy = q.iy AND w.ix = q.ix")
def interp_linear_same_crs(s, d):
    return warp.reproject(_cells(s, d), SOURCE, SAME, _layers(s, d), ["band"], "linear").withColumn("v", F.round("v", 6))


GEO = GridSpec(4326, (-106.105, 35.235, -106.100, 35.240), (0.0002, 0.0002))
_STEPS2, _EAST2, _NORTH2 = utm_sql("lon", "lat")


@query(f"WITH {_CELL}, u0 AS (SELECT oy.iy, ox.ix, -106.105::DOUBLE + ix * ((-106.1::DOUBLE - -106.105::DOUBLE) / 25) AS lon, 35.24::DOUBLE - iy * ((35.24::DOUBLE - 35.235::DOUBLE) / 25) AS lat FROM (SELECT unnest(range(25))::INT AS iy) oy, (SELECT unnest(range(25))::INT AS ix) ox), {_STEPS2}, q AS (SELECT b.band, iy, ix, ({_EAST2} - 400000) / 10 AS fx, (3900320 - {_NORTH2}) / 10 AS fy FROM u2, (SELECT DISTINCT band FROM px) b) SELECT q.band, q.iy, q.ix, c.v FROM q LEFT JOIN c ON c.band = q.band AND fx BETWEEN 0 AND 31 AND fy BETWEEN 0 AND 31 AND c.ix = ceil(fx - 0.5) AND c.iy = floor(fy + 0.5)")
def reproject_nearest_cross_crs(s, d):
    return warp.reproject(_cells(s, d), SOURCE, GEO, _layers(s, d), ["band"], "nearest")


# --- display -------------------------------------------------------------------------------------------------------


@query(f"WITH {PX}, r AS (SELECT quantile_cont(v, 0.02) AS p2, quantile_cont(v, 0.98) AS p98 FROM px) SELECT item, iy, ix, round((v - p2) / (p98 - p2), 9) AS v FROM px, r")
def percentile_stretch(s, d):
    p = pixels(s, d)
    both = p.join(F.broadcast(reduce.percentiles(p, exact=True)))
    return both.select("item", "iy", "ix", F.round(values.normalise(F.col("v"), F.col("p2"), F.col("p98")), 9).alias("v"))


def _wide(s, d):
    return joins.align_bands(_cells(s, d), ["iy", "ix"], {"A": "red", "N": "green"}, how=F.max)


_W = f"{_CELL}, w AS (SELECT iy, ix, max(v) FILTER (band = 'A') AS red, max(v) FILTER (band = 'N') AS green FROM c WHERE band IN ('A', 'N') GROUP BY ALL), q AS (SELECT iy, ix, floor(least(greatest(coalesce((red - 5) / 35 * 255, 0), 0), 255))::INT AS r, floor(least(greatest(coalesce((green - 5) / 35 * 255, 0), 0), 255))::INT AS g, CASE WHEN red IS NOT NULL AND green IS NOT NULL THEN 255 WHEN (iy // 8 + ix // 8) % 2 = 0 THEN 30 ELSE 0 END AS a FROM w)"


@query(f"WITH {_W} SELECT iy, ix, r, g, r AS b, a FROM q")
def quantise_rgba(s, d):
    return render.rgba(_wide(s, d), ["red", "green"], (5.0, 40.0))


@query(f"WITH {PX} SELECT DISTINCT iy, ix, (iy // 8 + ix // 8) % 2 = 0 AS lit FROM px")
def checkerboard(s, d):
    return pixels(s, d).select("iy", "ix", values.checker(F.col("iy"), F.col("ix")).alias("lit")).distinct()


@query()
def tile_png(s, d):
    pixels_ = render.rgba(_wide(s, d), ["red", "green"], (5.0, 40.0)).withColumn("tile", F.lit(0))
    return render.encode_tiles(pixels_, ["tile"], (SIDE, SIDE))


@query()
def fake_reader_scan(s, d):
    from ..sources import raster

    n = assets(s, d).agg(F.countDistinct("item").alias("times"), F.countDistinct("asset").alias("bands")).first()
    return raster.fake(s, n["times"], n["bands"], (16, 16), seed=1)


@query(f"WITH {SC}, a AS (SELECT DISTINCT cloud % 9 AS z, id % 20 AS x, id % 7 AS y FROM scenes WHERE cloud < 50), b AS (SELECT DISTINCT cloud % 9 AS z, id % 20 AS x, id % 7 AS y FROM scenes WHERE cloud >= 50) SELECT z, x, y, 'cancel' AS action FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT z, x, y, 'submit' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def viewport_diff(s, d):
    t = lambda k: scenes(s, d).filter(k).select((F.col("cloud") % 9).alias("z"), (F.col("id") % 20).alias("x"), (F.col("id") % 7).alias("y")).distinct()
    return joins.viewport_changes(t("cloud < 50"), t("cloud >= 50"))


@query("SELECT event_id, nullif(regexp_extract(u, '(^.+?)/(?:lab|notebook|voila)', 1), '') AS base, printf('%s/proxy/%d/%s/{z}/{y}/{x}.png', u, 8000, event_type) AS url FROM (SELECT event_id, event_type, 'http://h' || event_id || CASE event_id % 4 WHEN 0 THEN '/lab/tree' WHEN 1 THEN '/x/notebook' WHEN 2 THEN '/voila/lab' ELSE '/other' END AS u FROM events)")
def layer_urls(s, d):
    tail = F.element_at(F.array(*map(F.lit, ("/lab/tree", "/x/notebook", "/voila/lab", "/other"))), (F.col("event_id") % 4).cast("int") + 1)
    e = s.read.parquet(f"{d}/events.parquet").withColumn("u", F.concat(F.lit("http://h"), F.col("event_id"), tail))
    return e.select("event_id", media.notebook_base(F.col("u")).alias("base"), media.tile_url(F.col("u"), 8000, F.col("event_type")).alias("url"))
