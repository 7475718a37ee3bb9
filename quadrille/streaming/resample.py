"""Calendar resampling of a stream of pixels: tumbling windows with a watermark for late scenes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.reduce import HOWS
from .kept import keep


def weekly(px: DataFrame, by: Sequence[str] = (), how: str = "mean", time: str = "t", value: str = "v", late: str = "14 days") -> DataFrame:
    """Monday-to-Sunday weeks labelled by their Sunday, as the batch form. Works on batch and streaming frames."""
    d = px.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    got = d.groupBy(F.window("_t", "7 days", startTime="4 days").alias("_w"), *by).agg(HOWS[how](value).alias(value))
    return got.select((F.col("_w.start").cast("timestamp_ntz") + F.expr("INTERVAL 6 DAYS")).alias("bucket"), *by, value)


def keep_weeks(px: DataFrame, folder: str, checkpoint: str, by: Sequence[str] = (), how: str = "mean", time: str = "t", value: str = "v", late: str = "14 days") -> DataStreamWriter:
    """A writer that keeps the weeks in ``folder``, each batch's changed ones; ``kept.current`` by bucket and ``by`` reads them.

    Pixels that come more than ``late`` after their week's end, by the times in the stream, no longer change it.
    """
    return keep(weekly(px, by, how, time, value, late), folder, checkpoint)
