"""The stack: pixels of all items on one grid as a lazy DataFrame, with dimension tables for time and bands."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator, Mapping, Sequence
from collections.abc import Set as AbstractSet
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs, media, metadata, values
from ..functions.frames import ship
from ..functions.grid import Bbox, GridSpec, check_anchor, window_of
from ..functions.timing import timed
from ..operators import joins, mosaic, reduce, select, warp
from ..sources import env, readers
from . import chunks as chunking
from .planner import plan

NO_DEFAULT = object()
CHUNK_ROWS = 8


#: Labels of so many items are broadcast; those of more are joined by a shuffle.
BROADCAST_ITEMS = 500_000
#: Pixels in a batch that a task hands on.
BATCH = 1 << 16
#: Pixels that a task aggregates, about.
PIXELS = 1 << 20
#: Rasters of at most so many pixels are read whole, and all their cells in a batch are looked up together.
SMALL = 1 << 14
#: Rasters of these kinds have no reader here.
NO_READER = r"(?i)\.(jp2|j2k|jpx|jpf)(\?.*)?$"


@dataclass(frozen=True)
class Scan:
    """What is to be read: cells (one row an asset, with its window on the grid), and the part of the grid that is wanted.

    Selections narrow the cells and the part before any raster is opened.
    """

    cells: DataFrame
    spec: GridSpec
    chunk: tuple[int, int]
    reader: readers.Reader
    options: env.LayeredOptions
    missing: tuple
    resampling: str
    dtype: str
    #: First row and column of the part, and those behind its last.
    part: tuple[int, int, int, int]

    def of_items(self, time_dim: DataFrame) -> Scan:
        return replace(self, cells=self.cells.join(time_dim.select("time_idx"), "time_idx", "left_semi"))

    def of_bands(self, numbers: Sequence[int]) -> Scan:
        return replace(self, cells=self.cells.filter(F.col("band_idx").isin(list(numbers))))

    def cut(self, y0: int, x0: int, y1: int, x1: int) -> Scan:
        """A part of this part."""
        top, left = self.part[:2]
        return replace(self, part=(top + y0, left + x0, top + y1, left + x1))

    def work(self) -> DataFrame:
        """A row for each chunk of the part that an asset shares area with."""
        y0, x0, y1, x1 = self.part
        right, bottom = F.least(F.col("col_off") + F.col("w"), F.lit(float(x1))), F.least(F.col("row_off") + F.col("h"), F.lit(float(y1)))
        left, top = F.greatest("col_off", F.lit(float(x0))), F.greatest("row_off", F.lit(float(y0)))
        d = self.cells.withColumn("w", right - left).withColumn("h", bottom - top).withColumn("col_off", left).withColumn("row_off", top)
        d = joins.chunks_of(d, self.spec.shape, self.chunk)
        # a raster is opened once for so many rows of its chunks, not by one task for all of a large one
        # (of a given number of partitions: Spark would join those that are small, but what they lead to is large)
        parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return d.repartition(parts, "url", F.floor(F.col("cy") / CHUNK_ROWS)).sortWithinPartitions("url", "cy", "cx")

    def parts(self) -> int:
        """So many partitions that none gets more than PIXELS pixels, by the cells' windows."""
        y0, x0, y1, x1 = self.part
        side = lambda at, n, low, high: F.greatest(F.lit(0.0), F.least(F.col(at) + F.col(n), F.lit(float(high))) - F.greatest(F.col(at), F.lit(float(low))))
        n = self.cells.agg(F.sum(side("row_off", "h", y0, y1) * side("col_off", "w", x0, x1))).head()[0] or 0.0
        return max(int(self.cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(n // PIXELS) + 1)

    def pixels(self) -> DataFrame:
        return scan(self)


@dataclass
class Stack:
    """pixels: time_idx, band_idx, iy, ix, v; a missing pixel has no row or NULL. The tables are small.

    A stack of items holds a scan instead of pixels, and what is selected from it isn't read.
    """

    source: DataFrame | Scan
    time_dim: DataFrame
    band_dim: DataFrame
    spec: GridSpec
    xy_coords: str | bool = "topleft"
    shape: tuple[int, int, int, int] = (0, 0, 0, 0)
    chunks: tuple = ()
    fill_value: Any = float("nan")

    @functools.cached_property
    def pixels(self) -> DataFrame:
        return self.source.pixels() if isinstance(self.source, Scan) else self.source

    @property
    def attrs(self) -> dict:
        return self.spec.attrs()

    def epsg(self, default: Any = NO_DEFAULT) -> int:
        if self.spec is None:
            if default is NO_DEFAULT:
                raise ValueError("the stack has no CRS; give a default")
            return default
        return self.spec.epsg

    def bounds(self, to_epsg: int | None = None) -> Bbox:
        return crs.reproject_bounds(self.spec.bounds, self.spec.epsg, to_epsg or self.spec.epsg)

    def labelled(self) -> DataFrame:
        """With time, id, band, y and x for the indices."""
        labels = self.time_dim.select("time_idx", "time", "id")
        out = self.pixels.join(F.broadcast(labels) if self.shape[0] <= BROADCAST_ITEMS else labels, "time_idx").join(F.broadcast(self.band_dim.select("band_idx", "band")), "band_idx")
        if self.xy_coords:
            x, y = self.spec.xy(F.col("iy"), F.col("ix"), self.xy_coords)
            out = out.withColumn("y", y).withColumn("x", x)
        return out

    def sel(self, band: str | Sequence[str] | None = None, time: tuple[str | None, str | None] | None = None, where: Column | str | None = None) -> Stack:
        """By band names, a range of period labels, and a condition on item properties."""
        t, b, source = self.time_dim, self.band_dim, self.source
        if band is not None:
            b = b.filter(F.col("band").isin([band] if isinstance(band, str) else list(band)))
            numbers = [r[0] for r in b.select("band_idx").collect()]  # names of bands
            source = source.of_bands(numbers) if isinstance(source, Scan) else source.filter(F.col("band_idx").isin(numbers))
        if time is not None:
            t = select.between(t, *time, col="time")
        if where is not None:
            t = t.filter(where)
        if t is not self.time_dim:
            source = source.of_items(t) if isinstance(source, Scan) else source.join(t.select("time_idx"), "time_idx", "left_semi")
        return replace(self, source=source, time_dim=t, band_dim=b)

    def box(self, x: tuple[float, float], y: tuple[float, float]) -> Stack:
        """The pixels whose labels lie in both ranges, on a grid of their own."""
        height, width = self.spec.shape
        a, b, c, d = self.spec.bounds
        sx, sy = (c - a) / width, (d - b) / height
        shift = 0.5 if self.xy_coords == "center" else 0.0
        i0, i1 = int(np.ceil((min(x) - a) / sx - shift)), int(np.floor((max(x) - a) / sx - shift))
        k0, k1 = int(np.ceil((d - max(y)) / sy - shift)), int(np.floor((d - min(y)) / sy - shift))
        i0, k0, i1, k1 = max(0, i0), max(0, k0), min(width - 1, i1), min(height - 1, k1)
        if i0 > i1 or k0 > k1:
            raise ValueError(f"no pixel lies in x {x}, y {y}")
        if isinstance(self.source, Scan):
            px = self.source.cut(k0, i0, k1 + 1, i1 + 1)
        else:
            px = self.pixels.filter(F.col("ix").between(i0, i1) & F.col("iy").between(k0, k1)).withColumn("ix", F.col("ix") - i0).withColumn("iy", F.col("iy") - k0)
        spec = GridSpec(self.spec.epsg, (a + i0 * sx, d - (k1 + 1) * sy, a + (i1 + 1) * sx, d - k0 * sy), (sx, sy))
        return replace(self, source=px, spec=spec, shape=(*self.shape[:2], *spec.shape))

    def where(self, condition: Column) -> Stack:
        return replace(self, source=select.where(self.pixels, condition))

    def mosaic(self, dim: str = "time", reverse: bool = False, nodata: Any = float("nan")) -> DataFrame:
        order = {"time": "time_idx", "band": "band_idx"}[dim]
        by = [c for c in ("time_idx", "band_idx", "iy", "ix") if c != order]
        return mosaic.mosaic(self.pixels, by, order, reverse=reverse, nodata=nodata)

    def reduce(self, how: str, dims: Sequence[str] = ("time",)) -> DataFrame:
        gone = {{"time": "time_idx", "band": "band_idx", "y": "iy", "x": "ix"}[d] for d in dims}
        return reduce.reduce(self.pixels, [c for c in ("time_idx", "band_idx", "iy", "ix") if c not in gone], how)

    def resample(self, rule: str, how: str, by: Sequence[str] = ("band", "iy", "ix"), gaps: bool = False) -> DataFrame:
        return reduce.resample(self.labelled(), rule, how, by, time="time", gaps=gaps)

    def ratio(self, a: str, b: str) -> DataFrame:
        by = ["time_idx", "iy", "ix"]
        px = self.pixels.join(F.broadcast(self.band_dim.select("band_idx", "band")), "band_idx")
        if isinstance(self.source, Scan):  # about one row a group: Spark would join partitions by their compressed size
            px = px.repartition(self.source.parts(), *by)
        wide = joins.align_bands(px, by, {a: "_a", b: "_b"}, how=F.max)
        return wide.select("time_idx", "iy", "ix", values.ratio(F.col("_a"), F.col("_b")).alias("v"))

    def layers(self) -> DataFrame:
        return self.time_dim.select("time_idx").crossJoin(F.broadcast(self.band_dim.select("band_idx")))

    def reproject(self, spec: GridSpec, interpolation: str = "nearest", fill=None) -> Stack:
        if spec == self.spec:
            return self
        px = warp.reproject(self.pixels, self.spec, spec, self.layers(), interpolation=interpolation, fill=fill)
        return replace(self, source=px, spec=spec, shape=(*self.shape[:2], *spec.shape))

    def xyz_tile(self, x: int, y: int, z: int, interpolation: str = "linear", tilesize: int = 256) -> DataFrame | None:
        return warp.xyz_tile(self.pixels, self.spec, x, y, z, self.layers(), interpolation=interpolation, tilesize=tilesize)

    def dense(self) -> DataFrame:
        """Every pixel, missing ones as the fill value."""
        return joins.densify(self.pixels, self.layers(), self.spec.shape, ["time_idx", "band_idx"], self.fill_value)


#: Weights of the source pixels around a place, by their distance in pixels, and how many on either side count.
KERNELS = {
    "bilinear": (1, lambda d: 1 - d),
    "cubic": (2, lambda d: np.where(d <= 1, (1.5 * d - 2.5) * d * d + 1, ((-0.5 * d + 2.5) * d - 4) * d + 2)),
}


def most_common(v: np.ndarray) -> np.ndarray:
    """Of every column; the least of equally common values, NaN only if there is nothing else."""
    v = np.sort(v, axis=0)  # NaN last
    n = np.zeros(v.shape, np.int64)
    for i in range(len(v)):
        n[i] = np.where(np.isnan(v[i]), 0, 1 + (n[i - 1] * (v[i] == v[i - 1]) if i else 0))
    return np.take_along_axis(v, n.argmax(0)[None], 0)[0]


#: What a pixel gets from the source pixels at places spread over it.
AREA = {
    "average": lambda v: np.nanmean(v, axis=0),
    "sum": lambda v: np.where(np.isnan(v).all(0), np.nan, np.nansum(v, axis=0)),
    "min": lambda v: np.nanmin(v, axis=0),
    "max": lambda v: np.nanmax(v, axis=0),
    "med": lambda v: np.nanmedian(v, axis=0),
    "q1": lambda v: np.nanquantile(v, 0.25, axis=0),
    "q3": lambda v: np.nanquantile(v, 0.75, axis=0),
    "mode": most_common,
}
RESAMPLINGS = ("nearest", *KERNELS, *AREA)
#: Pixels that are read around what the output covers: kernels reach no further.
MARGIN = 3


def interpolated(data: np.ndarray, fx: np.ndarray, fy: np.ndarray, resampling: str) -> np.ndarray:
    """Weighted means around places in the raster; NaN has no weight, and the border's pixels go on beyond it."""
    h, w = data.shape
    side, weight = KERNELS[resampling]
    u, v = np.clip(fx - 0.5, 0, w - 1), np.clip(fy - 0.5, 0, h - 1)
    i, k = np.floor(u).astype(int), np.floor(v).astype(int)
    weights, total = np.zeros(len(fx)), np.zeros(len(fx))
    for dk in range(1 - side, side + 1):
        for di in range(1 - side, side + 1):
            value = data[np.clip(k + dk, 0, h - 1), np.clip(i + di, 0, w - 1)]
            q = weight(np.abs(u - i - di)) * weight(np.abs(v - k - dk))
            q = np.where(np.isnan(value), 0, q)
            weights += q
            total += np.where(np.isnan(value), 0, value) * q
    return np.where(np.abs(weights) > 1e-12, total / np.where(np.abs(weights) > 1e-12, weights, 1), np.nan)


def warp_block(raster: readers.Dataset, spec: GridSpec, iy: np.ndarray, ix: np.ndarray, box: Bbox, resampling: str) -> np.ndarray:
    """Values of output pixels: their centres are mapped to the raster, which without a transform fills its box.

    Those in AREA take the source pixels at a square of places in each pixel, as many on a side as it has source pixels. A
    raster with overviews is read at the coarsest one that is as fine as the output, and only where output pixels lie.
    """
    if resampling not in RESAMPLINGS:
        raise NotImplementedError(f"resampling {resampling!r} is not one of {', '.join(RESAMPLINGS)}")
    out = np.full(len(ix), np.nan)
    if not len(ix):
        return out
    xres, yres = spec.resolutions_xy

    warped = bool(raster.epsg) and raster.epsg != spec.epsg
    # without a change of CRS, what is outermost in the block is so in the raster
    outer = (iy, ix) if warped else (np.array([iy.min(), iy.min(), iy.max(), iy.max()]), np.array([ix.min(), ix.max(), ix.min(), ix.max()]))

    def place(of: readers.Dataset, dx: float, dy: float, iy: np.ndarray = iy, ix: np.ndarray = ix) -> tuple[np.ndarray, np.ndarray]:
        h, w = of.shape
        t = of.transform or ((box[2] - box[0]) / w, 0.0, box[0], 0.0, -(box[3] - box[1]) / h, box[3])
        det = t[0] * t[4] - t[1] * t[3]
        x, y = spec.bounds[0] + (ix + dx) * xres, spec.bounds[3] - (iy + dy) * yres
        if warped:
            x, y = crs.transform(x, y, spec.epsg, raster.epsg)
        return (t[4] * (x - t[2]) - t[1] * (y - t[5])) / det, (-t[3] * (x - t[2]) + t[0] * (y - t[5])) / det

    def step(of: readers.Dataset) -> float:
        """Source pixels that an output pixel has on a side."""
        (x0, y0), (x1, y1) = place(of, 0.0, 0.0, *outer), place(of, 1.0, 1.0, *outer)
        return float(np.median(np.maximum(np.abs(x1 - x0), np.abs(y1 - y0))))

    level = raster.at(step(raster)) if getattr(raster, "levels", ()) else raster
    h, w = level.shape
    ends = [place(level, dx, dy, *outer) for dx in (0.0, 1.0) for dy in (0.0, 1.0)]
    low, high = (np.array([f([e[k] for e in ends]) for k in (1, 0)]) for f in (np.min, np.max))
    y0, x0 = np.clip(np.floor(low).astype(int) - MARGIN, 0, (h, w))
    y1, x1 = np.clip(np.ceil(high).astype(int) + MARGIN, 0, (h, w))
    if y0 >= y1 or x0 >= x1:
        return out
    data = level.block(y0, y1, x0, x1)

    def nearest(dx: float, dy: float) -> np.ndarray:
        fx, fy = place(level, dx, dy)
        inside = (fx >= 0) & (fx < w) & (fy >= 0) & (fy < h)
        out = np.full(len(fx), np.nan)
        out[inside] = data[np.floor(fy[inside]).astype(int) - y0, np.floor(fx[inside]).astype(int) - x0]
        return out

    if resampling == "nearest":
        return nearest(0.5, 0.5)
    if resampling in KERNELS:
        fx, fy = place(level, 0.5, 0.5)
        inside = (fx >= 0) & (fx < w) & (fy >= 0) & (fy < h)
        out[inside] = interpolated(data, fx[inside] - x0, fy[inside] - y0, resampling)
        return out
    n = max(1, round(step(level)))
    spread = (np.arange(n) + 0.5) / n
    values_ = np.stack([nearest(dx, dy) for dy in spread for dx in spread])
    some = ~np.isnan(values_).all(0)
    if some.any():
        out[some] = AREA[resampling](values_[:, some])
    return out


def nearest_of(raster: readers.Dataset, data: np.ndarray, spec: GridSpec, iy: np.ndarray, ix: np.ndarray, box: Sequence[np.ndarray]) -> np.ndarray:
    """What ``warp_block`` gives for "nearest" without a change of CRS, from a whole raster and a box for every pixel."""
    (h, w), (xres, yres) = raster.shape, spec.resolutions_xy
    t = raster.transform or ((box[2] - box[0]) / w, 0.0, box[0], 0.0, -(box[3] - box[1]) / h, box[3])
    det = t[0] * t[4] - t[1] * t[3]
    x, y = spec.bounds[0] + (ix + 0.5) * xres, spec.bounds[3] - (iy + 0.5) * yres
    fx, fy = (t[4] * (x - t[2]) - t[1] * (y - t[5])) / det, (-t[3] * (x - t[2]) + t[0] * (y - t[5])) / det
    inside = (fx >= 0) & (fx < w) & (fy >= 0) & (fy < h)
    out = np.full(len(fx), np.nan)
    out[inside] = data[np.floor(fy[inside]).astype(int), np.floor(fx[inside]).astype(int)]
    return out


def scan(s: Scan) -> DataFrame:
    """Pixels of the scan's part. Tasks get rows (cell, cy, cx), sorted by url, so that a raster is opened once.

    Cells of a small raster are looked up together: most of the time would go into calls that do little each.
    """
    spec, (ch, cw), (top, left, bottom, right) = s.spec, s.chunk, s.part
    reader, options, missing, resampling = s.reader, s.options, s.missing, s.resampling
    names = ["time_idx", "band_idx", "iy", "ix", "v"]

    def pixels_of(r: dict, raster: readers.Dataset) -> list[np.ndarray]:
        y0, x0 = max(top, r["cy"] * ch), max(left, r["cx"] * cw)
        y1, x1 = min(bottom, (r["cy"] + 1) * ch), min(right, (r["cx"] + 1) * cw)
        if not raster.epsg or raster.epsg == spec.epsg:  # else the box is only that of the projected corners
            y0, y1 = max(y0, int(r["row_off"]) - 1), min(y1, int(r["row_off"] + r["h"]) + 2)
            x0, x1 = max(x0, int(r["col_off"]) - 1), min(x1, int(r["col_off"] + r["w"]) + 2)
        iy, ix = (v.ravel() for v in np.mgrid[y0:y1, x0:x1])
        v = warp_block(raster, spec, iy, ix, (r["minx"], r["miny"], r["maxx"], r["maxy"]), resampling)
        ok = ~np.isnan(v)
        n = int(ok.sum())
        return [np.full(n, r["time_idx"], np.int32), np.full(n, r["band_idx"], np.int32), (iy[ok] - top).astype(np.int32), (ix[ok] - left).astype(np.int32), v[ok] * r["scale"] + r["offset"]]

    def whole(raster: readers.Dataset) -> np.ndarray | None:
        """All pixels, if the cells may be looked up in them; what can't be read whole is read cell by cell."""
        h, w = raster.shape
        if resampling != "nearest" or getattr(raster, "levels", ()) or (raster.epsg and raster.epsg != spec.epsg) or not 0 < h * w <= SMALL:
            return None
        try:
            return raster.block(0, h, 0, w)
        except Exception:  # it is met again, and judged, at the cells that need it
            return None

    def looked_up(c: dict[str, np.ndarray], raster: readers.Dataset, data: np.ndarray) -> Iterator[list[np.ndarray]]:
        """As ``pixels_of``, for cells of one raster."""
        y0, x0 = np.maximum(np.maximum(top, c["cy"] * ch), c["row_off"].astype(int) - 1), np.maximum(np.maximum(left, c["cx"] * cw), c["col_off"].astype(int) - 1)
        y1 = np.minimum(np.minimum(bottom, (c["cy"] + 1) * ch), (c["row_off"] + c["h"]).astype(int) + 2)
        x1 = np.minimum(np.minimum(right, (c["cx"] + 1) * cw), (c["col_off"] + c["w"]).astype(int) + 2)
        nx = np.maximum(0, x1 - x0)
        ends = np.cumsum(nx * np.maximum(0, y1 - y0))
        a = 0
        while a < len(ends):
            before = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + BATCH, "right")))
            k = np.repeat(np.arange(a, b), np.diff(ends[a:b], prepend=before))
            place = np.arange(before, ends[b - 1]) - np.concatenate([[0], ends])[k]
            iy, ix = y0[k] + place // nx[k], x0[k] + place % nx[k]
            v = nearest_of(raster, data, spec, iy, ix, [c[n][k] for n in ("minx", "miny", "maxx", "maxy")])
            ok = ~np.isnan(v)
            k = k[ok]
            yield [c["time_idx"][k].astype(np.int32), c["band_idx"][k].astype(np.int32), (iy[ok] - top).astype(np.int32), (ix[ok] - left).astype(np.int32), v[ok] * c["scale"][k] + c["offset"][k]]
            a = b

    def found(batch: pa.RecordBatch, raster: readers.Dataset, data: np.ndarray | None, url: str) -> Iterator[list[np.ndarray]]:
        """Pixels of cells of one raster."""
        if data is not None:
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names if n != "url"}
            if all(np.isfinite(x).all() for x in c.values()):
                yield from looked_up(c, raster, data)
                return
        for r in batch.to_pylist():
            try:
                yield pixels_of(r, raster)
            except Exception as e:
                env.tolerated(e, missing, url, "reading")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, raster, data, n = None, None, None, 0
        held: list[list[np.ndarray]] = []

        def gathered() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
            held.clear()
            return out

        for batch in batches:
            at = 0
            for url, same in itertools.groupby(batch.column("url").to_pylist()):
                begin, at = at, at + sum(1 for _ in same)
                if url != last:
                    last, raster, data = url, None, None
                    try:
                        raster = reader(last, {**options.for_open(), **options.for_read()})
                    except Exception as e:
                        env.tolerated(e, missing, last, "opening")
                    else:
                        data = whole(raster)
                if raster is None:
                    continue
                for some in found(batch.slice(begin, at - begin), raster, data, url):
                    held.append(some)
                    n += len(some[0])
                    if n >= BATCH:
                        yield gathered()
                        n = 0
        if n:
            yield gathered()

    ship(s.cells.sparkSession)
    work = s.work().select("time_idx", "band_idx", "url", "minx", "miny", "maxx", "maxy", "scale", "offset", "col_off", "row_off", "w", "h", "cy", "cx")
    px = work.mapInArrow(run, "time_idx int, band_idx int, iy int, ix int, v double")
    return px.withColumn("v", F.col("v").cast(s.dtype))


def dims(items: DataFrame, properties: bool | str | Sequence[str] | None, bands: Sequence[str], band_coords: bool, epsg: int, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Labels of the time axis (one column a property) and of the band axis (fields that agree wherever they are set)."""
    time = metadata.utc(F.col("properties")["datetime"]).alias("time")
    keys: list[str] = []
    if properties is True:
        found = items.select(F.explode(F.map_keys("properties")).alias("k")).distinct().collect()  # names of fields
        keys = sorted(r["k"] for r in found if r["k"] != "datetime")
    elif properties:
        keys = [k for k in ([properties] if isinstance(properties, str) else properties) if k != "datetime"]
    labels = metadata.labels(items, [k for k in keys if k not in ("id", "time", "time_idx")])
    t = items.select("time_idx", time, "id", *[c.alias(k) for k, c in labels.items()])
    names = spark.createDataFrame([(i, b) for i, b in enumerate(bands)], "band_idx int, band string")
    if not band_coords or not bands:
        return t, names
    a = items.select(F.col("time_idx").alias("item"), F.explode("assets").alias("band", "f")).filter(F.col("band").isin(list(bands)))
    long = a.select("item", "band", F.explode("f").alias("key", "value")).filter(~F.col("key").isin("href", "type", "roles", "proj:epsg", "epsg"))
    same = metadata.all_same(long, ["band"]).collect()  # a few fields a band
    rename = {"sar:polarizations": "polarization"}
    fields = sorted({rename.get(r["key"], r["key"]) for r in same if r["key"] != "eo:bands"})
    got = {(r["band"], rename.get(r["key"], r["key"])): r["value"] if r["key"] == "eo:bands" else metadata.label(r["value"]) for r in same}
    eo = ("common_name", "center_wavelength", "full_width_half_max")
    table = spark.createDataFrame([(b, *[got.get((b, f)) for f in fields], got.get((b, "eo:bands"))) for b in bands], "band string" + "".join(f", `{f}` string" for f in fields) + ", _eo string")
    band = metadata.eo_band(F.col("_eo"))
    table = table.select("band", *[F.col(f"`{f}`") for f in fields if f not in eo], *[band[f].alias(f) for f in eo], F.lit(epsg).alias("epsg"))
    return t, names.join(F.broadcast(table), "band").select("band_idx", *table.columns)


def stack(
    spark: SparkSession,
    items: Any,
    assets: Sequence[str] | AbstractSet[str] | None = frozenset(media.RASTER_TYPES),
    epsg: int | None = None,
    resolution: float | Sequence[float] | None = None,
    bounds: Bbox | None = None,
    bounds_latlon: Bbox | None = None,
    snap_bounds: bool = True,
    resampling: str = "nearest",
    chunksize: Any = 1024,
    dtype="float64",
    fill_value: Any = float("nan"),
    rescale: bool = True,
    sortby_date: str | bool = "asc",
    xy_coords: str | bool = "topleft",
    properties: bool | str | Sequence[str] | None = True,
    band_coords: bool = True,
    gdal_env: env.LayeredOptions | Mapping | None = None,
    errors_as_nodata: Iterable[BaseException] = env.MISSING,
    reader: readers.Reader = readers.pick,
    strict_dtype: bool = False,
) -> Stack:
    """A lazy stack of the items' single-band assets on a common grid; no raster is read before an action."""
    values.check_fill(dtype, fill_value, strict_dtype)
    if resampling not in RESAMPLINGS:
        raise NotImplementedError(f"resampling {resampling!r} is not one of {', '.join(RESAMPLINGS)}")
    if xy_coords is not False:
        check_anchor(xy_coords)
    with timed("planning"):
        p = plan(spark, items, assets, epsg, resolution, bounds, bounds_latlon, snap_bounds, rescale, dtype, sortby_date, strict_dtype)
    height, width = p.spec.shape
    if reader is readers.pick:
        closed = p.cells.filter(F.col("url").rlike(NO_READER)).select("url").head()
        if closed:
            raise NotImplementedError(f"{closed[0]!r}: there is no reader for JPEG 2000; give one, or choose other assets")
    shape = (p.n_times, len(p.bands), height, width)
    chunks = chunking.normalize(chunksize, shape, dtype)
    box = [F.col(c) for c in ("minx", "miny", "maxx", "maxy")]
    xres, yres = p.spec.resolutions_xy
    cells = p.cells.select("*", *[c.alias(n) for c, n in zip(window_of(box, p.spec.bounds[0], p.spec.bounds[3], xres, yres), ("col_off", "row_off", "w", "h"), strict=True)])
    options = gdal_env if isinstance(gdal_env, env.LayeredOptions) else env.LayeredOptions(always=gdal_env or {})
    part = Scan(cells, p.spec, (max(chunks[2]), max(chunks[3])), reader, options, tuple(errors_as_nodata), resampling, values.spark_type(dtype), (0, 0, height, width))
    with timed("labels"):
        t, b = dims(p.items, properties, p.bands, band_coords, p.spec.epsg, spark)
    return Stack(part, t, b, p.spec, xy_coords, shape, chunks, fill_value)
