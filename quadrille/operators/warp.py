"""Resampling pixels onto another grid: inverse mapping of output pixels, then an equality join on source indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs
from ..functions.grid import GridSpec, pixel_x, pixel_y


def positions(x: Column, y: Column, x0: float, y0: float, sx: float, sy: float) -> tuple[Column, Column]:
    """Fractional source column and row of a point; x0, y0 are the labels of the top-left pixel."""
    return (x - x0) / sx, (F.lit(y0) - y) / sy


def inside(fx: Column, fy: Column, width: int, height: int) -> Column:
    """Between the first and the last label; what lies beyond the last label is outside, even within its pixel."""
    return fx.between(0, width - 1) & fy.between(0, height - 1)


def nearest(fx: Column, fy: Column) -> tuple[Column, Column]:
    """Ties go to the lower coordinate: the left column, and the lower row, which has the larger index."""
    return F.ceil(fx - 0.5).cast("int"), F.floor(fy + 0.5).cast("int")


def output_pixels(spec: GridSpec) -> tuple[Column, Column]:
    height, width = spec.shape
    a, b, c, d = spec.bounds
    xres, yres = spec.resolutions_xy
    return pixel_x(F.col("ix"), a, c, width, xres), pixel_y(F.col("iy"), b, d, height, yres)


def target_grid(layers: DataFrame, spec: GridSpec) -> DataFrame:
    height, width = spec.shape
    return layers.withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))


def source_positions(grid: DataFrame, source: GridSpec, target: GridSpec) -> DataFrame:
    """Adds fx, fy: where each output pixel's label lies in the source."""
    x, y = crs.transform(*output_pixels(target), target.epsg, source.epsg)
    height, width = source.shape
    a, b, c, d = source.bounds
    fx, fy = positions(x, y, a, d, (c - a) / width, (d - b) / height)
    return grid.withColumn("fx", fx).withColumn("fy", fy)


def neighbours(fx: Column, fy: Column, width: int, height: int) -> Column:
    """The up to four source pixels of linear interpolation with their weights."""
    i = F.least(F.floor(fx), F.lit(max(0, width - 2))).cast("int")
    k = F.least(F.floor(fy), F.lit(max(0, height - 2))).cast("int")
    a, b = fx - i, fy - k
    one = lambda dx, dy, w: F.struct((i + dx).alias("sx"), (k + dy).alias("sy"), w.alias("wt"))
    return F.array(one(0, 0, (1 - a) * (1 - b)), one(1, 0, a * (1 - b)), one(0, 1, (1 - a) * b), one(1, 1, a * b))


def reproject(px: DataFrame, source: GridSpec, target: GridSpec, layers: DataFrame, keys: Sequence[str] = ("time_idx", "band_idx"), interpolation: str = "nearest", fill=None, value: str = "v") -> DataFrame:
    """Pixels (keys, iy, ix, v) on the target grid. layers holds the distinct keys. Bools go through numbers and back."""
    if interpolation not in ("nearest", "linear"):
        raise ValueError(f"interpolation must be 'nearest' or 'linear', not {interpolation!r}")
    kind = dict(px.dtypes)[value]
    src = px.select(*keys, F.col("iy").alias("sy"), F.col("ix").alias("sx"), (F.col(value).cast("int") if kind == "boolean" else F.col(value)).alias("_s"))
    height, width = source.shape
    grid = source_positions(target_grid(layers, target), source, target)
    grid = grid.withColumn("_in", F.coalesce(inside(F.col("fx"), F.col("fy"), width, height), F.lit(False)))
    if interpolation == "nearest":
        sx, sy = nearest(F.col("fx"), F.col("fy"))
        out = grid.withColumn("sx", F.when(F.col("_in"), sx)).withColumn("sy", F.when(F.col("_in"), sy)).join(src, [*keys, "sx", "sy"], "left")
        out = out.select(*keys, "iy", "ix", F.col("_s").alias(value))
    else:
        n = F.when(F.col("_in"), neighbours(F.col("fx"), F.col("fy"), width, height))
        wide = grid.withColumn("_n", F.explode_outer(n)).select(*keys, "iy", "ix", F.col("_n.sx").alias("sx"), F.col("_n.sy").alias("sy"), F.col("_n.wt").alias("wt"))
        both = wide.join(src, [*keys, "sx", "sy"], "left")
        whole = F.count("_s") == F.count(F.lit(1))  # any missing neighbour makes the pixel missing
        out = both.groupBy(*keys, "iy", "ix").agg(F.when(whole, F.sum(F.col("_s") * F.col("wt"))).alias(value))
    if kind == "boolean":
        out = out.withColumn(value, F.col(value) != 0)
    return out if fill is None else out.withColumn(value, F.coalesce(value, F.lit(fill)))


def xyz_tile(px: DataFrame, source: GridSpec, x: int, y: int, z: int, layers: DataFrame, keys: Sequence[str] = ("time_idx", "band_idx"), interpolation: str = "linear", tilesize: int = 256) -> DataFrame | None:
    """A web-mercator tile of the pixels, or None if they don't overlap."""
    box = tuple(float(v) for v in crs.tile_bounds(z, x, y))
    own = crs.reproject_bounds(source.bounds, source.epsg, 3857)
    if not (max(box[0], own[0]) < min(box[2], own[2]) and max(box[1], own[1]) < min(box[3], own[3])):
        return None
    res = (box[2] - box[0]) / tilesize
    return reproject(px, source, GridSpec(3857, box, (res, res)), layers, keys, interpolation)
