"""Selecting by label: bands, properties, time periods, space; and masks."""

from __future__ import annotations

import calendar
import datetime as dt
import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry


def bands(px: DataFrame, names: str | Sequence[str], col: str = "band") -> DataFrame:
    return px.filter(F.col(col).isin([names] if isinstance(names, str) else list(names)))


def where_items(px: DataFrame, items: DataFrame, condition: Column | str, key: str | Column) -> DataFrame:
    """Pixels of the items that meet a condition on their properties."""
    picked = items.filter(condition)
    return px.join(picked.select(key) if isinstance(key, str) else picked, key, "left_semi")


def period(label: str) -> tuple[dt.datetime, dt.datetime]:
    """First instant of a period such as "2020", "2020-04" or "2020-04-03", and of the next one."""
    m = re.fullmatch(r"(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?", label)
    if not m:
        at = dt.datetime.fromisoformat(label)
        return at, at + dt.timedelta(microseconds=1)
    y, mo, d = (int(x) if x else None for x in m.groups())
    start = dt.datetime(y, mo or 1, d or 1)
    days = 1 if d else calendar.monthrange(y, mo)[1] if mo else 366 if calendar.isleap(y) else 365
    return start, start + dt.timedelta(days=days)


def between(px: DataFrame, start: str | None, end: str | None, col: str = "t") -> DataFrame:
    """Both ends are labels of whole periods and count."""
    c = F.col(col)
    if start is not None:
        px = px.filter(c >= F.lit(period(start)[0]).cast("timestamp_ntz"))
    if end is not None:
        px = px.filter(c < F.lit(period(end)[1]).cast("timestamp_ntz"))
    return px


def box(px: DataFrame, x: tuple[float, float], y: tuple[float, float], xcol: str = "x", ycol: str = "y") -> DataFrame:
    """Both ends of both ranges count, in either order."""
    return px.filter(F.col(xcol).between(min(x), max(x)) & F.col(ycol).between(min(y), max(y)))


def where(px: DataFrame, condition: Column, value: str = "v") -> DataFrame:
    """Values that don't meet the condition become NULL."""
    return px.withColumn(value, F.when(condition, F.col(value)))


def search(items: DataFrame, point: tuple[float, float] | None = None, bbox: Sequence[float] | None = None, intersects: str | None = None, collections: Sequence[str] | None = None, start: str | None = None, end: str | None = None, time: str = "datetime") -> DataFrame:
    """Catalogue search over minx, miny, maxx, maxy, collection and a time column; what only touches intersects here.

    intersects: a polygon, several, or a feature with one, as GeoJSON text.
    """
    if point is not None:
        x, y = map(F.lit, point)
        items = items.filter((F.col("minx") <= x) & (x <= F.col("maxx")) & (F.col("miny") <= y) & (y <= F.col("maxy")))
    if bbox is not None:
        a, b, c, d = map(F.lit, bbox)
        items = items.filter((F.col("minx") <= c) & (F.col("maxx") >= a) & (F.col("miny") <= d) & (F.col("maxy") >= b))
    if intersects is not None:
        shape = json.loads(intersects)
        shape = shape.get("geometry", shape)
        rings = {"Polygon": lambda c: c, "MultiPolygon": lambda c: [r for p in c for r in p]}[shape["type"]](shape["coordinates"])
        xs, ys = zip(*[p[:2] for r in rings for p in r], strict=True)
        items = search(items, bbox=(min(xs), min(ys), max(xs), max(ys)), time=time)
        items = items.filter(geometry.meets_box(geometry.literal_edges(rings), [F.col(c) for c in ("minx", "miny", "maxx", "maxy")]))
    if collections is not None:
        items = items.filter(F.col("collection").isin(list(collections)))
    return between(items, start, end, time)


def search_areas(items: DataFrame, areas: DataFrame, cell: float = 1.0, edges: str = "edges") -> DataFrame:
    """Items and areas that share a point: all columns of both, a row for each such pair.

    items have minx, miny, maxx, maxy; areas have the edges of polygons (see functions.geometry). Both are dealt to the
    cells of a grid that their boxes touch, so the search is an equality join by cell; of the cells that a pair has in
    common the first one counts. Areas and items without a place match nothing. Columns must have different names.
    """
    box = geometry.box_of_edges(F.col(edges))
    areas = areas.withColumns(dict(zip(("_minx", "_miny", "_maxx", "_maxy"), box, strict=True)))

    def dealt(rows: DataFrame, names: Sequence[str], to: str) -> DataFrame:
        lows = [F.floor(F.col(n) / cell).cast("long") for n in names]
        rows = rows.withColumns({f"_{to}x0": lows[0], f"_{to}y0": lows[1]}).filter((F.col(names[0]) <= F.col(names[2])) & (F.col(names[1]) <= F.col(names[3])))
        return rows.withColumn("_cx", F.explode(F.sequence(lows[0], lows[2]))).withColumn("_cy", F.explode(F.sequence(lows[1], lows[3])))

    own = ("minx", "miny", "maxx", "maxy")
    both = dealt(items, own, "i").join(dealt(areas, [f"_{n}" for n in own], "a"), ["_cx", "_cy"])
    both = both.filter((F.col("_cx") == F.greatest("_ix0", "_ax0")) & (F.col("_cy") == F.greatest("_iy0", "_ay0")))
    return both.filter(geometry.meets_box(F.col(edges), [F.col(c) for c in own])).select(*items.columns, *[c for c in areas.columns if not c.startswith("_min") and not c.startswith("_max")])
