"""Layers on a web map: registered by name, rendered as slippy-map tiles, all tiles of a view or a pyramid in one job."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs
from ..functions.grid import Bbox, GridSpec
from . import render, warp


def tiles_of_bounds(rows: DataFrame, box: Sequence[Column], zoom: Column | int) -> DataFrame:
    """A row for every tile (z, x, y) that a box in degrees touches; its right edge belongs to the tile on its left."""
    z = (zoom if isinstance(zoom, Column) else F.lit(zoom)).cast("int")
    n = F.pow(F.lit(2.0), z)
    fy = lambda lat: F.lit(0.5) - F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) / (2 * math.pi)
    inside = lambda v: F.greatest(F.lit(0.0), F.least(F.floor(v).cast("double"), n - 1)).cast("int")
    west, south, east, north = box
    columns = F.sequence(inside((west / 360.0 + 0.5) * n - 1e-9), inside((east / 360.0 + 0.5) * n - 1e-9))
    lines = F.sequence(inside(fy(north) * n), inside(fy(south) * n))
    return rows.withColumn("z", z).withColumn("x", F.explode(columns)).withColumn("y", F.explode(lines))


def tile_pixels(wide: DataFrame, names: Sequence[str], source: GridSpec, tiles: DataFrame, interpolation: str = "nearest", tilesize: int = 256) -> DataFrame:
    """(z, x, y, iy, ix, names): wide has a column for each band by (iy, ix); all tiles are mapped by one join."""
    if interpolation not in ("nearest", "linear"):
        raise ValueError(f"interpolation must be 'nearest' or 'linear', not {interpolation!r}")
    keys = ["z", "x", "y", "iy", "ix"]
    side = F.sequence(F.lit(0), F.lit(tilesize - 1))
    grid = tiles.select("z", "x", "y").withColumn("iy", F.explode(side)).withColumn("ix", F.explode(side))
    left, _, right, top = crs.tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    res = (right - left) / tilesize
    px, py = crs.transform(left + F.col("ix") * res, top - F.col("iy") * res, 3857, source.epsg)
    height, width = source.shape
    a, b, c, d = source.bounds
    fx, fy = warp.positions(px, py, a, d, (c - a) / width, (d - b) / height)
    grid = grid.withColumn("fx", fx).withColumn("fy", fy)
    within = F.coalesce(warp.inside(F.col("fx"), F.col("fy"), width, height), F.lit(False))
    src = wide.select(F.col("iy").alias("sy"), F.col("ix").alias("sx"), *[F.col(n).alias(f"_{n}") for n in names])
    if interpolation == "nearest":
        sx, sy = warp.nearest(F.col("fx"), F.col("fy"))
        out = grid.withColumn("sx", F.when(within, sx)).withColumn("sy", F.when(within, sy)).join(src, ["sx", "sy"], "left")
        return out.select(*keys, *[F.col(f"_{n}").alias(n) for n in names])
    near = grid.withColumn("_n", F.explode_outer(F.when(within, warp.neighbours(F.col("fx"), F.col("fy"), width, height))))
    near = near.select(*keys, F.col("_n.sx").alias("sx"), F.col("_n.sy").alias("sy"), F.col("_n.wt").alias("wt")).join(src, ["sx", "sy"], "left")
    mean = lambda n: F.when(F.count(f"_{n}") == F.count(F.lit(1)), F.sum(F.col(f"_{n}") * F.col("wt")))
    return near.groupBy(*keys).agg(*[mean(n).alias(n) for n in names])


@dataclass
class Layer:
    """A 2-D or 3-D picture: pixels (iy, ix, one column for each of 1 to 3 bands), on a grid, with how it is coloured."""

    wide: DataFrame
    names: list[str]
    spec: GridSpec
    vrange: tuple[float, float]
    cmap: Sequence | None = None
    checkerboard: bool = True
    tilesize: int = 256
    interpolation: str = "linear"

    @property
    def token(self) -> str:
        """A name that depends on what is shown, and only on that."""
        spark = self.wide.sparkSession
        parts = [self.wide._jdf.queryExecution().analyzed().canonicalized().semanticHash(), str(self.names), repr(self.spec), str(self.vrange), str(self.cmap), self.checkerboard, self.tilesize, self.interpolation]
        return spark.range(1).select(render.token(*[F.lit(str(p)).alias(f"p{i}") for i, p in enumerate(parts)])).head()[0]

    def box(self) -> Bbox:
        return crs.reproject_bounds(self.spec.bounds, self.spec.epsg, 4326)

    def zoom(self) -> int:
        """The zoom at which the layer fills the view: by its longer side in metres, at its middle latitude."""
        west, south, east, north = crs.reproject_bounds(self.spec.bounds, self.spec.epsg, 3857)
        lat = sum(self.box()[1::2]) / 2
        size = max(east - west, north - south)
        return self.wide.sparkSession.range(1).select(crs.auto_zoom(F.lit(lat), F.lit(size))).head()[0]

    def tiles(self, zooms: Iterable[int] | None = None) -> DataFrame:
        """z, x, y and png of every tile that the layer touches."""
        zooms = list(zooms) if zooms is not None else [self.zoom()]
        levels = self.wide.sparkSession.createDataFrame([(int(z),) for z in zooms], "z int")
        return self.picture(tiles_of_bounds(levels, [F.lit(v) for v in self.box()], F.col("z")).select("z", "x", "y"))

    def picture(self, wanted: DataFrame) -> DataFrame:
        """z, x, y and png of the given tiles."""
        pixels = tile_pixels(self.wide, self.names, self.spec, wanted, self.interpolation, self.tilesize)
        return render.encode_tiles(render.rgba(pixels, self.names, self.vrange, self.checkerboard, self.cmap), ["z", "x", "y"], (self.tilesize, self.tilesize))

    def write(self, folder: str, zooms: Iterable[int] | None = None) -> DataFrame:
        """Writes ``folder/token/z/y/x.png``; gives z, tiles and bytes. A repeated task writes the same files again."""
        root = f"{folder.rstrip('/')}/{self.token}"

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow.fs as pafs

            fs, path = pafs.FileSystem.from_uri(root)
            for batch in batches:
                size = []
                for z, x, y, png in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                    fs.create_dir(f"{path}/{z}/{y}", recursive=True)
                    with fs.open_output_stream(f"{path}/{z}/{y}/{x}.png") as f:
                        f.write(png)
                    size.append(len(png))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64())], ["z", "size"])

        done = self.tiles(zooms).select("z", "x", "y", "png").mapInArrow(run, "z int, size long")
        return done.groupBy("z").agg(F.count(F.lit(1)).alias("tiles"), F.sum("size").alias("bytes"))


@dataclass
class Map:
    """Layers by name; adding one under a name that is there replaces it."""

    layers: dict[str, Layer] = field(default_factory=dict)

    def add(self, wide: DataFrame, names: Sequence[str] | str, spec: GridSpec, name: str | None = None, vrange: tuple[float, float] | None = None, cmap: Sequence | None = None, **more) -> Layer:
        """Without a range it is the 2nd and 98th percentile of all bands; a single band without colours gets a colour map."""
        names = [names] if isinstance(names, str) else list(names)
        render.check_display(len(names), vrange, cmap)
        if vrange is None:
            kinds = dict(wide.dtypes)
            every = wide.select(F.explode(F.array(*[F.col(n).cast("double") for n in names])).alias("v"))
            vrange = (0.0, 1.0) if all(kinds[n] == "boolean" for n in names) else render.default_range(every)
            if None in vrange:
                raise ValueError("there is no pixel to take a range from; give one")
        if cmap is None and len(names) == 1:
            cmap = [tuple(int(v) for v in c) for c in render.colour_table()]
        wide = wide.select("iy", "ix", *[F.col(n).cast("double").alias(n) for n in names])
        layer = Layer(wide, names, spec, (float(vrange[0]), float(vrange[1])), cmap, **more)
        self.layers[name or layer.token] = layer
        return layer
