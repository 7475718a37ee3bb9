"""Frames that are written once, numbering without a task that gets all rows, and this package in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of the session's cluster."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    out = Path(tempfile.mkdtemp(prefix="quadrille-ship-")) / "quadrille_rasters.zip"  # Spark sends it to the workers
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "quadrille").rglob("*.py")):
            z.write(p, os.path.relpath(p, root))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session that the driver and all executors share."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        sc.setCheckpointDir(base)
    at = sc._jsc.sc().getCheckpointDir().get()
    return at.replace("file:/", "file:///", 1) if at.startswith("file:/") and not at.startswith("file://") else at


def materialised(df: DataFrame) -> DataFrame:
    """Writes a table once, so that what it takes to make it is not planned or run again by all that follows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(rows: DataFrame, order: Sequence[Column], index: str, then: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Numbers rows from 0 on in a total order: range partitions are sorted on their own, and counts make the offsets.

    What is put in one task are the counts, one row a partition. Spark reads ``rows`` twice, first to find the ranges; what
    is costly to make of each row by itself is better left to ``then``, which runs once, after the exchange.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).transform(then)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row within its partition
    rows = materialised(rows.withColumn("_part", F.spark_partition_id()).withColumn("_place", place))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(counts), "_part").withColumn(index, (F.col("_before") + F.col("_place")).cast("int")).drop("_part", "_place", "_before")
