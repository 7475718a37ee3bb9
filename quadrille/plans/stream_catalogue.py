"""Registered queries over streams: the tables are read as streams of files, and what the streams have kept is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import shared_folder
from ..streaming.kept import current
from ..streaming.mosaic import keep_mosaic
from ..streaming.resample import keep_weeks
from .catalogue import query
from .views import PX, pixels_of, table

BY = ["band", "iy", "ix"]


def arriving(s: SparkSession, d: str) -> DataFrame:
    """The pixel view as a stream."""
    return pixels_of(s.readStream.schema(table(s, d, "lineitem").schema).parquet(f"{d}/lineitem.parquet*"))


def new_folder(s: SparkSession) -> str:
    return f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"


@query(f"WITH {PX} SELECT band, iy, ix, arg_max(v, ord) FILTER (WHERE v IS NOT NULL) AS v FROM px GROUP BY ALL")
def stream_mosaic_last_valid(s, d):
    at = new_folder(s)
    keep_mosaic(arriving(s, d), f"{at}/kept", f"{at}/state", BY, "ord").trigger(availableNow=True).start().awaitTermination()
    return current(s, f"{at}/kept", BY).select(*BY, "v")


@query(f"WITH {PX} SELECT date_trunc('week', t)::TIMESTAMP + INTERVAL 6 DAY AS bucket, band, round(avg(v), 9) AS v FROM px GROUP BY ALL")
def stream_weekly_mean(s, d):
    at = new_folder(s)
    keep_weeks(arriving(s, d), f"{at}/kept", f"{at}/state", ["band"]).trigger(availableNow=True).start().awaitTermination()
    return current(s, f"{at}/kept", ["bucket", "band"]).select("bucket", "band", F.round("v", 9).alias("v"))
