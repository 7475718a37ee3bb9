"""Registered queries that go from items to pixels: every order is an item of constant rasters, planned and stacked."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata
from ..functions.frames import shared_folder
from ..functions.grid import GridSpec
from ..operators import warp
from ..sources import catalogues
from ..sources import items as sources
from .catalogue import query
from .planner import asset_ids, plan
from .stack import Stack, stack
from .views import table

X0, Y0, SIDE = 400_000.0, 4_000_000.0, 100.0


def catalogue_items(s: SparkSession, d: str) -> DataFrame:
    """json and item_idx of an item an order, 100 m wide. B1 tells its box, B2 (every third order) shape and transform."""
    o = table(s, d, "orders")
    gx, gy = F.pmod("o_orderkey", F.lit(37)), F.pmod("o_custkey", F.lit(29))
    minx, miny = X0 + gx * SIDE, Y0 + gy * SIDE
    kind = F.lit("image/tiff; application=geotiff")
    href = lambda n: F.concat(F.lit("const://1/1/"), F.pmod("o_custkey", F.lit(n)).cast("string"))
    b1 = F.struct(kind.alias("type"), href(1000).alias("href"), F.array(minx, miny, minx + SIDE, miny + SIDE).alias("proj:bbox"), F.array(F.struct(F.lit(0.5).alias("scale"), F.lit(3.0).alias("offset"))).alias("raster:bands"), F.lit("red").alias("name"))
    b2 = F.struct(kind.alias("type"), href(500).alias("href"), F.array(F.lit(1), F.lit(1)).alias("proj:shape"), F.array(F.lit(SIDE), F.lit(0.0), minx, F.lit(0.0), F.lit(-SIDE), miny + SIDE).alias("proj:transform"), F.col("o_orderpriority").alias("name"))
    assets = F.struct(b1.alias("B1"), F.when(F.col("o_custkey") % 3 == 0, b2).alias("B2"), F.struct(F.lit("application/json").alias("type")).alias("meta"))
    properties = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), F.pmod("o_custkey", F.lit(100)).alias("eo:cloud_cover"), F.lit(32613).alias("proj:epsg"))
    item = F.struct(F.col("o_orderkey").cast("string").alias("id"), properties.alias("properties"), assets.alias("assets"))
    return o.select(F.col("o_orderkey").alias("item_idx"), F.to_json(item).alias("json"))


IT = """it AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS dt, (row_number() OVER (ORDER BY strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), o_orderkey) - 1)::INT AS time_idx,
  (o_orderkey % 37)::INT AS gx, (o_custkey % 29)::INT AS gy, o_orderpriority AS p FROM orders),
  ext AS (SELECT min(gx) AS gx0, max(gy) + 1 AS gy1 FROM it),
  cell AS (SELECT *, 0 AS band_idx, (c % 1000) * 0.5::DOUBLE + 3 AS v FROM it UNION ALL SELECT *, 1, (c % 500)::DOUBLE FROM it WHERE c % 3 = 0),
  spx AS (SELECT time_idx, band_idx, dt, c, ((gy1 - gy - 1) * 2 + dy)::INT AS iy, ((gx - gx0) * 2 + dx)::INT AS ix, v FROM cell, ext, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx))"""


def stacked(s: SparkSession, d: str, **more) -> Stack:
    return stack(s, catalogue_items(s, d), **{"resolution": SIDE / 2, "chunksize": 16, "properties": "eo:cloud_cover", **more})


@query(f"WITH {IT} SELECT time_idx, band_idx, iy, ix, v FROM spx")
def stack_pixels(s, d):
    return stacked(s, d).pixels


@query(f"WITH {IT} SELECT band_idx, iy, ix, arg_max(v, time_idx) AS v FROM spx GROUP BY ALL")
def stack_mosaic(s, d):
    return stacked(s, d).mosaic()


@query(f"WITH {IT} SELECT time_idx, iy, ix, (max(v) FILTER (band_idx = 0) - max(v) FILTER (band_idx = 1)) / nullif(max(v) FILTER (band_idx = 0) + max(v) FILTER (band_idx = 1), 0) AS v FROM spx GROUP BY ALL")
def stack_band_ratio(s, d):
    return stacked(s, d).ratio("B1", "B2")


@query(f"WITH {IT} SELECT date_trunc('week', dt)::TIMESTAMP + INTERVAL 6 DAY AS bucket, CASE band_idx WHEN 0 THEN 'B1' ELSE 'B2' END AS band, round(avg(v), 9) AS v FROM spx WHERE c % 100 < 40 AND iy < 8 AND ix BETWEEN 2 AND 21 GROUP BY ALL")
def stack_weekly_mean_of_clear_items(s, d):
    st = stacked(s, d).sel(where="CAST(`eo:cloud_cover` AS DOUBLE) < 40")
    a, top = st.spec.bounds[0], st.spec.bounds[3]
    box = st.box(x=(a + 2 * SIDE / 2, a + 21 * SIDE / 2), y=(top, top - 7 * SIDE / 2))
    return box.resample("1w", "mean", by=["band"]).withColumn("v", F.round("v", 9))


@query(f"WITH {IT} SELECT time_idx, band_idx, iy - 4 AS iy, ix - 6 AS ix, v FROM spx WHERE band_idx = 0 AND c % 100 < 60 AND dt >= '1994-01-01' AND dt < '1996-07-01' AND iy BETWEEN 4 AND 23 AND ix BETWEEN 6 AND 25")
def stack_selection(s, d):
    """A band, a range of months, clear items and a box: only the rasters that hold such pixels are opened."""
    st = stacked(s, d)
    a, top = st.spec.bounds[0], st.spec.bounds[3]
    box = st.box(x=(a + 6 * SIDE / 2, a + 25 * SIDE / 2), y=(top - 4 * SIDE / 2, top - 23 * SIDE / 2))
    return box.sel(band="B1", time=("1994-01", "1996-06"), where="CAST(`eo:cloud_cover` AS DOUBLE) < 60").pixels


@query(f"WITH {IT} SELECT time_idx, dt::TIMESTAMP AS time, k::VARCHAR AS id, (c % 100)::VARCHAR AS cloud FROM it")
def stack_time_labels(s, d):
    return stacked(s, d).time_dim.select("time_idx", "time", "id", F.col("eo:cloud_cover").cast("string").alias("cloud"))


@query("SELECT o_orderkey AS k, o_custkey % 100 AS cloud, CASE WHEN o_custkey % 4 <> 0 THEN o_totalprice END AS price, o_orderstatus = 'F' AS done, o_orderpriority AS priority, 'x' AS instruments, CASE WHEN o_custkey % 3 = 0 THEN '[' || o_custkey % 7 || ']' ELSE '[' || o_custkey % 7 || ',9]' END AS looks, CASE WHEN o_custkey % 2 = 0 THEN '1' ELSE 'two' END AS mixed FROM orders")
def metadata_typed(s, d):
    """Properties with the types they have in JSON: numbers, truth values, texts, lists of one and of several lengths."""
    o, c = table(s, d, "orders"), F.col("o_custkey")
    more = F.struct(
        (c % 100).alias("eo:cloud_cover"), F.when(c % 4 != 0, F.col("o_totalprice")).alias("price"), (F.col("o_orderstatus") == "F").alias("done"), F.col("o_orderpriority").alias("priority"),
        F.array(F.lit("x")).alias("instruments"), F.when(c % 3 == 0, F.array(c % 7)).otherwise(F.array(c % 7, F.lit(9))).alias("looks"), F.array(c % 7, F.lit(1)).alias("axis"),
    )
    text = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), more.alias("properties")))
    mixed = F.concat(F.substring(text, F.lit(1), F.length(text) - 2), F.lit(',"mixed":'), F.when(c % 2 == 0, F.lit("1")).otherwise(F.lit('"two"')), F.lit("}}"))
    items = sources.rows(s, o.select(F.col("o_orderkey").alias("item_idx"), mixed.alias("json")))
    names = {"eo:cloud_cover": "cloud", "price": "price", "done": "done", "priority": "priority", "instruments": "instruments", "looks": "looks", "axis": "axis", "mixed": "mixed"}
    got = metadata.labels(items, list(names))
    return items.select(F.col("item_idx").alias("k"), *[(F.to_json(v) if k == "looks" else v).alias(names[k]) for k, v in got.items()])


@query(f"WITH {IT} SELECT 0 AS band_idx, 'B1' AS band, 'red' AS name, 32613 AS epsg UNION ALL SELECT 1, 'B2', CASE WHEN count(DISTINCT p) = 1 THEN min(p) END, 32613 FROM it WHERE c % 3 = 0")
def stack_band_labels(s, d):
    return stacked(s, d).band_dim.select("band_idx", "band", "name", "epsg")


@query(f"WITH {IT} SELECT time_idx, 0 AS band_idx, 'B1' AS band, k AS item_idx, 'const://1/1/' || c % 1000 AS url, 400000 + gx * 100::DOUBLE AS minx, 4000100 + gy * 100::DOUBLE AS maxy, 0.5::DOUBLE AS scale, 3::DOUBLE AS \"offset\" FROM it UNION ALL SELECT time_idx, 1, 'B2', k, 'const://1/1/' || c % 500, 400000 + gx * 100::DOUBLE, 4000100 + gy * 100::DOUBLE, 1, 0 FROM it WHERE c % 3 = 0")
def plan_cells(s, d):
    return plan(s, catalogue_items(s, d), resolution=SIDE / 2).cells.select("time_idx", "band_idx", "band", "item_idx", "url", "minx", "maxy", "scale", "offset")


@query(f"WITH {IT}, b AS (SELECT * FROM it WHERE c % 3 = 0 AND gx < 12 AND gx > 2 AND gy > 3 AND gy < 21), t AS (SELECT k, (row_number() OVER (ORDER BY strftime(dt, '%Y-%m-%dT%H:%M:%SZ'), k) - 1)::INT AS time_idx FROM b) SELECT time_idx, 0 AS band_idx, k AS item_idx, 32613 AS epsg, 400300::DOUBLE AS minx, 4002100::DOUBLE AS maxy, 100::DOUBLE AS xres, 17 AS height, 9 AS width FROM t")
def plan_grid_within_bounds(s, d):
    """Resolution from the transforms, bounds as given, items outside of them gone, the others numbered without gaps."""
    p = plan(s, catalogue_items(s, d), assets=["B2"], bounds=(X0 + 310, Y0 + 410, X0 + 1190, Y0 + 2090))
    (height, width), spec = p.spec.shape, p.spec
    return p.cells.select("time_idx", "band_idx", "item_idx", F.lit(spec.epsg).alias("epsg"), F.lit(spec.bounds[0]).alias("minx"), F.lit(spec.bounds[3]).alias("maxy"), F.lit(spec.resolutions_xy[0]).alias("xres"), F.lit(height).alias("height"), F.lit(width).alias("width"))


@query("WITH n AS (SELECT o_custkey AS c, list(DISTINCT 'A' || o_orderkey % 50 ORDER BY 'A' || o_orderkey % 50) AS names FROM orders GROUP BY c), best AS (SELECT names FROM n ORDER BY len(names) DESC, c LIMIT 1) SELECT (i - 1)::INT AS place, names[i] AS asset FROM best, unnest(range(1, len(names) + 1)) AS t(i)")
def plan_assets_of_fullest_item(s, d):
    """An item a customer, with an asset for each of the numbers that its orders have; the first of the fullest names the bands."""
    names = F.array_sort(F.collect_set(F.concat(F.lit("A"), (F.col("o_orderkey") % 50).cast("string"))))
    items = table(s, d, "orders").groupBy(F.col("o_custkey").alias("item_idx")).agg(names.alias("n"))
    assets = F.map_from_arrays("n", F.transform("n", lambda n: F.create_map(F.lit("href"), n)))
    items = items.select("item_idx", F.to_json(F.struct(F.col("item_idx").cast("string").alias("id"), assets.alias("assets"))).alias("json"))
    found = asset_ids(sources.ordered(sources.rows(s, items)), None)
    return s.createDataFrame(list(enumerate(found)), "place int, asset string")


@query(f"WITH {IT}, m AS (SELECT band_idx, iy, ix, arg_max(v, time_idx) AS v FROM spx GROUP BY ALL), g AS (SELECT b::INT AS band_idx, y::INT AS iy, x::INT AS ix FROM (SELECT unnest([0, 1]) AS b), (SELECT unnest(range(5)) AS y), (SELECT unnest(range(7)) AS x)) SELECT g.band_idx, g.iy, g.ix, m.v FROM g LEFT JOIN m ON m.band_idx = g.band_idx AND m.iy = 4 + g.iy * 2 AND m.ix = 2 + g.ix * 2")
def stack_mosaic_reprojected(s, d):
    """Nearest pixels of the mosaic on a coarser grid whose pixel corners are corners of the stack's pixels."""
    st = stacked(s, d)
    a, top = st.spec.bounds[0], st.spec.bounds[3]
    to = GridSpec(32613, (a + SIDE, top - 2 * SIDE - 5 * SIDE, a + 8 * SIDE, top - 2 * SIDE), (SIDE, SIDE))
    return warp.reproject(st.mosaic(), st.spec, to, st.band_dim.select("band_idx"), ["band_idx"], "nearest")


@query("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::INT AS item_idx, o_orderkey::VARCHAR AS id, o_custkey % 100 AS cloud, list_contains(['B1', CASE WHEN o_custkey % 3 = 0 THEN 'B2' END, 'meta'], 'B2') IS TRUE AS both FROM orders")
def catalogue_crawl(s, d):
    """All orders' items, published as a tree of linked files and read back by following its links."""
    root = catalogues.publish(catalogue_items(s, d), f"{shared_folder(s)}/catalogue-{uuid.uuid4().hex}", per_page=500, fan=20)
    items = sources.rows(s, catalogues.crawl(s, root))
    return items.select("item_idx", "id", F.col("properties")["eo:cloud_cover"].cast("long").alias("cloud"), F.col("assets").getItem("B2").isNotNull().alias("both"))
