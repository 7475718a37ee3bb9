"""Raster sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fake(spark: SparkSession, n_times: int, n_bands: int, shape: tuple[int, int], seed: int = 0) -> DataFrame:
    """Random pixels on a generated grid, to measure everything but reading."""
    h, w = shape
    i = F.col("id")
    d = spark.range(n_times * n_bands * h * w)
    return d.select((i / (n_bands * h * w)).cast("int").alias("time_idx"), ((i / (h * w)).cast("long") % n_bands).cast("int").alias("band_idx"), ((i / w).cast("long") % h).cast("int").alias("iy"), (i % w).cast("int").alias("ix"), F.rand(seed).alias("v"))
