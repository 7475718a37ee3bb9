"""Joins that array code hides: chunks with assets, bands with bands, a grid with its pixels, values with a global one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import first_chunk, last_chunk


def chunks_of(windows: DataFrame, shape: tuple[int, int], chunk: tuple[int, int]) -> DataFrame:
    """Rows with a fractional window (col_off, row_off, w, h) -> a row for each chunk (cy, cx) it shares area with.

    The range join of chunks and windows becomes arithmetic and an equality; windows without area meet no chunk.
    """
    (height, width), (ch, cw) = shape, chunk
    d = windows.filter((F.col("w") > 0) & (F.col("h") > 0))
    d = d.withColumn("_x0", first_chunk(F.col("col_off"), cw)).withColumn("_x1", last_chunk(F.col("col_off"), F.col("w"), width, cw))
    d = d.withColumn("_y0", first_chunk(F.col("row_off"), ch)).withColumn("_y1", last_chunk(F.col("row_off"), F.col("h"), height, ch))
    d = d.filter("_x0 <= _x1 AND _y0 <= _y1")
    d = d.withColumn("cy", F.explode(F.sequence("_y0", "_y1"))).withColumn("cx", F.explode(F.sequence("_x0", "_x1")))
    return d.drop("_x0", "_x1", "_y0", "_y1")


def align_bands(px: DataFrame, by: Sequence[str], names: Mapping[str, str], how=F.avg, band: str = "band", value: str = "v") -> DataFrame:
    """A column for each band by conditional aggregates: one shuffle, where aligning by joins takes one a band."""
    return px.filter(F.col(band).isin(list(names))).groupBy(*by).agg(*[how(F.when(F.col(band) == b, F.col(value))).alias(out) for b, out in names.items()])


def with_global(rows: DataFrame, px: DataFrame, *aggs) -> DataFrame:
    """Adds aggregates over all of px to rows: a broadcast of one row."""
    return rows.join(F.broadcast(px.agg(*aggs)))


def densify(px: DataFrame, layers: DataFrame, shape: tuple[int, int], keys: Sequence[str], fill=None, value: str = "v") -> DataFrame:
    """Every pixel of every layer, missing ones with the fill."""
    height, width = shape
    grid = layers.withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    out = grid.join(px, [*keys, "iy", "ix"], "left")
    return out if fill is None else out.withColumn(value, F.coalesce(value, F.lit(fill)))


def explode_blocks(blocks: DataFrame, width: int, data: str = "data", value: str = "v") -> DataFrame:
    """Block rows -> pixel rows (iy, ix, value)."""
    rest = [c for c in blocks.columns if c != data]
    d = blocks.select(*rest, F.posexplode(data).alias("_p", value))
    return d.select(*rest, F.floor(F.col("_p") / width).cast("int").alias("iy"), (F.col("_p") % width).cast("int").alias("ix"), value)


def viewport_changes(current: DataFrame, view: DataFrame, keys: Sequence[str] = ("z", "x", "y")) -> DataFrame:
    """Tiles to cancel (no longer in view) and to submit (new in view)."""
    gone = current.join(view, list(keys), "left_anti").select(*keys, F.lit("cancel").alias("action"))
    return gone.unionByName(view.join(current, list(keys), "left_anti").select(*keys, F.lit("submit").alias("action")))
