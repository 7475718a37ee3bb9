"""Results of streams that are kept as batches of changed rows, and read as the latest of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def keep(changes: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer of a streaming aggregate: each batch's changed rows are a folder of their own.

    A batch that is repeated after a failure overwrites its folder, so what is kept stays right.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/_batch={batch}")

    return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def current(spark: SparkSession, folder: str, by: Sequence[str]) -> DataFrame | None:
    """What ``keep`` has written: of each group of ``by`` what the latest batch says. None before the first batch."""
    try:
        rows = spark.read.option("basePath", folder).parquet(folder.rstrip("/") + "/_batch=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    rest = [c for c in rows.columns if c not in (*by, "_batch")]
    latest = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), "_batch").alias("_r"))
    return latest.select(*by, "_r.*")


def compacted(spark: SparkSession, folder: str, to: str, by: Sequence[str]) -> None:
    """Writes what is kept as one batch to another folder, so that reading it doesn't take all batches that ever were.

    Its number is the latest one's; batches that come after it can be written next to it.
    """
    rows = current(spark, folder, by)
    if rows is None:
        return
    last = spark.read.option("basePath", folder).parquet(folder.rstrip("/") + "/_batch=*").agg(F.max("_batch")).head()[0]
    rows.write.mode("overwrite").parquet(f"{to.rstrip('/')}/_batch={last}")
