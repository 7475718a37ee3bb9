"""Mosaics over streams of scenes: a pixel's best layer is kept, and a late scene replaces it only if it ranks higher."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.mosaic import NAN, check_nodata, valid_pixel
from .kept import keep


def stream_mosaic(px: DataFrame, by: Sequence[str], order: str, value: str = "v", reverse: bool = False, nodata=NAN) -> DataFrame:
    """(by, value, order) of the valid value that is last by ``order`` so far (first with ``reverse``).

    The state is one row a pixel, so it is bounded by the grid and not by the number of scenes; whichever way scenes arrive,
    the mosaic is that of a batch. Pixels without a valid value have NULL. With equal orders the greater value stays (the
    smaller with ``reverse``), so that the arrival doesn't matter there either. Works on batch and streaming frames.
    """
    check_nodata(dict(px.dtypes)[value], nodata)
    best = (F.min if reverse else F.max)(F.when(valid_pixel(F.col(value), nodata), F.struct(F.col(order).alias(order), F.col(value).alias(value))))
    return px.groupBy(*by).agg(best.alias("_best")).select(*by, F.col("_best")[value].alias(value), F.col("_best")[order].alias(order))


def keep_mosaic(px: DataFrame, folder: str, checkpoint: str, by: Sequence[str], order: str, value: str = "v", reverse: bool = False, nodata=NAN) -> DataStreamWriter:
    """A writer that keeps a mosaic in ``folder``, each batch's changed pixels; ``kept.current`` reads it."""
    return keep(stream_mosaic(px, by, order, value, reverse, nodata), folder, checkpoint)
