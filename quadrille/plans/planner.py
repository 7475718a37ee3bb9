"""From items to a common grid and a table of cells, by metadata alone: no raster is opened.

Items are exploded to one row per asset. Two small aggregates come to the driver: the CRS (it must be known before boxes
can be projected), then bounds, finest resolution and the first error. Errors are found in the order of items, assets
and steps, as the first row of that order, whatever partition it is in.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence
from collections.abc import Set as AbstractSet
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs, media, metadata
from ..functions.frames import materialised
from ..functions.grid import Bbox, GridSpec, overlaps, snap
from ..functions.values import check_scale
from ..sources import items as sources

BANDS = "array<struct<scale:double,offset:double>>"
ERRORS = {
    "bands": ValueError,
    "no crs": ValueError,
    "crs": ValueError,
    "rectilinear": NotImplementedError,
    "resolution": ValueError,
    "bounds": ValueError,
}


@dataclass
class Plan:
    spec: GridSpec
    #: time_idx, band_idx, item_idx, id, band, url, minx, miny, maxx, maxy, scale, offset; a missing cell has no row.
    cells: DataFrame
    #: The items that are left: time_idx, item_idx, id, properties, assets, typed.
    items: DataFrame
    bands: list[str]
    n_times: int


def asset_ids(rows: DataFrame, assets: Sequence[str] | AbstractSet[str] | None) -> list[str]:
    """The asset names to use, in order: of the fullest item, of matching media types, or as given."""
    if assets is None:
        best = rows.agg(F.max_by(F.map_keys("assets"), F.struct(F.size("assets"), -F.col("time_idx")))).head()[0]
        if best is None:
            raise ValueError("No items")
        return list(best)
    if not isinstance(assets, AbstractSet):
        return list(assets)
    a = rows.select("time_idx", F.posexplode("assets").alias("pos", "asset", "fields"))
    a = a.select("asset", F.col("fields")["type"].alias("type"), F.struct("time_idx", "pos").alias("ordinal"))
    untyped = [r[0] for r in a.groupBy("asset").agg(F.count("type").alias("n")).filter("n = 0").select("asset").collect()]
    if untyped:
        warnings.warn(f"a choice by type leaves out assets without a type on any item: {sorted(untyped)}; name assets to keep them", stacklevel=3)
    return [r["asset"] for r in metadata.select_by_type(a, assets).orderBy("first").collect()]


def _number(text: Column, kind: str = "array<double>") -> Column:
    return F.from_json(text, kind)


def union_box() -> list[Column]:
    """Aggregates: the box of all boxes."""
    return [F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")]


def finest(x: str, y: str) -> list[Column]:
    """Aggregates: the least pixel sizes, whichever way the axes run."""
    return [F.min(F.abs(x)).alias("xres"), F.min(F.abs(y)).alias("yres")]


def plan(
    spark: SparkSession,
    items: Any,
    assets: Sequence[str] | AbstractSet[str] | None = frozenset(media.RASTER_TYPES),
    epsg: int | None = None,
    resolution: float | Sequence[float] | None = None,
    bounds: Bbox | None = None,
    bounds_latlon: Bbox | None = None,
    snap_bounds: bool = True,
    rescale: bool = True,
    dtype="float64",
    sortby_date: str | bool = "asc",
    strict_dtype: bool = False,
) -> Plan:
    if bounds is not None and bounds_latlon is not None:
        raise ValueError(f"bounds {bounds} and bounds_latlon {bounds_latlon} are both given; one is enough")
    if resolution is not None and not isinstance(resolution, Sequence):
        resolution = (float(resolution), float(resolution))
    rows = sources.ordered_rows(spark, items, sortby_date)
    if not rows.head(1):
        raise ValueError("No items")
    names = asset_ids(rows, assets)
    if not names:
        raise ValueError("Zero assets are left to stack")

    order = F.array_position(F.array(*map(F.lit, names)), F.col("asset")).cast("int") - 1
    a = rows.select("time_idx", "item_idx", "id", "properties", F.col("bbox").alias("lonlat"), F.explode("assets").alias("asset", "f"))
    a = a.filter(F.col("asset").isin(names)).withColumn("band_idx", order)
    field = lambda k: metadata.inherited(F.col("f"), F.col("properties"), k)
    shape, transform = field("proj:shape"), field("proj:transform")
    rb = _number(F.col("f")["raster:bands"], BANDS)
    a = a.select(
        "time_idx",
        "band_idx",
        "item_idx",
        "id",
        F.col("asset").alias("band"),
        F.col("f")["href"].alias("url"),
        "lonlat",
        field("proj:epsg").cast("int").alias("epsg"),
        _number(field("proj:bbox")).alias("box"),
        _number(shape).alias("shape"),
        _number(transform).alias("af"),
        (shape.eqNullSafe(F.col("properties")["proj:shape"]) & transform.eqNullSafe(F.col("properties")["proj:transform"])).alias("as_item"),
        F.size(rb).alias("n_bands"),
        F.coalesce(F.get(rb, 0)["scale"], F.lit(1.0)).alias("scale"),
        F.coalesce(F.get(rb, 0)["offset"], F.lit(0.0)).alias("offset"),
    )
    a = materialised(a)
    at = F.struct("time_idx", "band_idx")
    whole = F.lit(strict_dtype) | (F.col("scale") != F.floor("scale")) | (F.col("offset") != F.floor("offset"))
    first = a.agg(F.min_by("epsg", F.when(F.col("epsg").isNotNull(), at)).alias("epsg"), F.collect_set("epsg").alias("codes"), F.min_by(F.struct("scale", "offset"), F.when(whole, at)).alias("odd")).head()
    out_epsg = epsg if epsg is not None else first["epsg"]
    if rescale and first["odd"]:  # all others are whole numbers, which any type holds
        check_scale(dtype, first["odd"]["scale"], first["odd"]["offset"], strict_dtype)

    checks = [("bands", (F.col("n_bands") >= 0) & (F.col("n_bands") != 1))]
    if epsg is None:
        checks += [("no crs", F.col("epsg").isNull()), ("crs", F.col("epsg") != F.lit(out_epsg).cast("int"))]
    agreed = epsg is not None or len(first["codes"]) <= 1  # else the check of the CRS fails, and no box is needed
    if out_epsg is not None and agreed and not [c for c in first["codes"] if not crs.known(c) and c != out_epsg]:
        if bounds_latlon is not None:
            bounds = crs.reproject_bounds(bounds_latlon, 4326, out_epsg)
        codes = sorted(first["codes"])
        six, known = [F.col("af")[i] for i in range(6)], F.col("epsg").isNotNull()
        same, has_af = F.col("epsg") == out_epsg, F.col("af").isNotNull() & known
        box_of = lambda c: crs.points(crs.corners([F.col(c)[i] for i in range(4)]))
        one = F.lit(1.0)
        corners, origin = metadata.first_known(
            [
                ("proj:bbox", F.when(F.col("box").isNotNull() & known & F.col("as_item"), box_of("box"))),
                ("proj:transform", F.when(has_af & F.col("shape").isNotNull(), crs.points(crs.affine_corners(six, F.col("shape")[0], F.col("shape")[1])))),
                ("bbox", F.when(F.col("lonlat").isNotNull(), box_of("lonlat"))),
            ]
        )
        source = F.when(origin == "bbox", 4326).otherwise(F.col("epsg"))
        a = a.withColumn("corners", crs.images(corners, source, sorted({*codes, 4326}), out_epsg))
        a = a.withColumn("pixel", F.when(has_af & ~same, crs.images(crs.points(crs.affine_corners(six, one, one)), F.col("epsg"), codes, out_epsg)))
        a = materialised(a)  # so that nothing is projected again by what follows
        a = a.withColumns(dict(zip(("minx", "miny", "maxx", "maxy"), crs.box_of_points(F.col("corners")), strict=True)))
        pixel = crs.box_of_points(F.col("pixel"))
        res_x = F.when(has_af & same, F.abs(six[0])).when(has_af, pixel[2] - pixel[0]).otherwise((F.col("maxx") - F.col("minx")) / F.col("shape")[1])
        res_y = F.when(has_af & same, F.abs(six[4])).when(has_af, pixel[3] - pixel[1]).otherwise((F.col("maxy") - F.col("miny")) / F.col("shape")[0])
        a = a.withColumn("res_x", res_x).withColumn("res_y", res_y)
        if resolution is None:
            straight = ((six[1] == 0) & (six[3] == 0)) | ((six[0] == 0) & (six[4] == 0))
            checks += [("rectilinear", has_af & same & ~straight), ("resolution", F.col("res_x").isNull() | F.col("res_y").isNull())]
        if bounds is None:
            checks.append(("bounds", F.col("minx").isNull()))
        extent = [*union_box(), *finest("res_x", "res_y")]
    elif out_epsg is not None and epsg is not None:
        raise NotImplementedError(f"no transform from {sorted(first['codes'])} to EPSG:{out_epsg}")
    else:
        extent = []
    error = F.coalesce(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(name)) for name, hit in checks])
    got = a.agg(F.min_by(F.struct(error.alias("what"), "id", "time_idx", "band", "epsg"), F.when(error.isNotNull(), at)).alias("e"), F.count(F.lit(1)).alias("n"), *extent).head()
    if got["e"] is not None:
        e = got["e"]
        raise ERRORS[e["what"]](message(e["what"], e, out_epsg))
    if out_epsg is None or not got["n"]:
        raise AssertionError(f"none of the assets {names} is on any item: nothing is known of the grid")
    box, res = tuple(got[2:6]), tuple(got[6:8])
    bounds_out = bounds if bounds is not None else box
    res = tuple(float(r) for r in resolution) if resolution is not None else res
    if None in bounds_out or None in res:
        raise AssertionError(f"bounds {bounds_out} and resolution {res} are not known")
    if bounds is not None:  # the resolution has seen all assets, also those that go now
        a = a.filter(F.col("minx").isNotNull() & overlaps([F.col(c) for c in ("minx", "miny", "maxx", "maxy")], bounds))
    spec = GridSpec(out_epsg, snap(bounds_out, res) if snap_bounds else tuple(bounds_out), res)
    return _pruned(rows, a.filter(F.col("minx").isNotNull()), spec, names, rescale)


def message(what: str, e, out_epsg) -> str:
    where = f"asset {e['band']!r} of item {e['time_idx']} {e['id']!r}"
    return {
        "bands": f"{where} has other than one entry in raster:bands; name the assets to stack without it",
        "no crs": f"{where} names no CRS, so there is no common one; give epsg",
        "crs": f"{where} is in EPSG:{e['epsg']}, the first asset in EPSG:{out_epsg}; give epsg",
        "rectilinear": f"the transform of {where} follows no axis, so it tells no resolution; give one",
        "resolution": f"{where} tells no resolution, by proj:transform with proj:epsg or by proj:shape with a box; give one",
        "bounds": f"{where} tells no bounds, by proj:bbox, proj:shape with proj:transform, or its item's bbox; give some",
    }[what]


def _pruned(rows: DataFrame, cells: DataFrame, spec: GridSpec, names: list[str], rescale: bool) -> Plan:
    """Drops items and assets without any cell. Only if items go, the others are numbered anew, without gaps."""
    left = cells.agg(F.collect_set("band").alias("bands"), F.count_distinct("time_idx").alias("n")).head()  # asset names
    bands = [n for n in names if n in left["bands"]]
    order = F.array_position(F.array(*map(F.lit, bands or [""])), F.col("band")).cast("int") - 1
    cells = cells.withColumn("band_idx", order)
    if left["n"] < rows.count():
        cells = metadata.reindex(cells.withColumnRenamed("time_idx", "_t"), "_t", "time_idx")
        rows = rows.drop("time_idx").join(cells.select("item_idx", "time_idx").distinct(), "item_idx")
    keep = ["time_idx", "band_idx", "item_idx", "id", "band", "url", "minx", "miny", "maxx", "maxy"]
    one, zero = (F.col("scale"), F.col("offset")) if rescale else (F.lit(1.0), F.lit(0.0))
    return Plan(spec, cells.select(*keep, one.alias("scale"), zero.alias("offset")), rows.select("time_idx", "item_idx", "id", "properties", "assets", "typed"), bands, left["n"])
