"""Session helpers and column expressions shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: What separates words in every operator but the licence scan.
SPACE = "[\\x20\\x09-\\x0D]+"
#: A frame of at most this many rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Parts into which the rows of a key are dealt out.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does exactly that on pure ASCII, and is faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; null counts as no text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; spark.checkpoint.dir names the place and must be set on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Writes the frame to reliable storage once and cuts its lineage."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession, "rdd"))
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint behind a check of the size; beyond it the frame is left to a shuffle join."""
    return F.broadcast(df) if df.select(F.lit(1)).limit(rows + 1).count() <= rows else df


def salted(rows: DataFrame, few: DataFrame, key: str, by: list[str], parts: int = SALTS) -> DataFrame:
    """rows joined with few, which has one row a key: it goes to every part of its key, rows to one each by a hash of ``by``."""
    few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")).join(few, [key, "_salt"]).drop("_salt")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes to differ from all columns of the frame."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def only_kept(docs: DataFrame, keys: list[Column], judged: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    judged: the keys in the same order, then whether such rows stay. Rows that are in it and stay repeat all keys: one
    of them is kept. Rows that are not in it stay. If few rows are judged, docs are not shuffled.
    """
    if not judged.head(1):
        return docs
    names = [free_name(docs, f"_key{i}") for i in range(len(keys))]
    marked = docs.withColumns(dict(zip(names, keys, strict=True)))
    judged = judged.toDF(*[f"_judged{i}" for i in range(len(keys))], "_stays")

    def match(t: DataFrame) -> Column:
        pairs = [same(marked[n], t[f"_judged{i}"]) for i, n in enumerate(names)]
        return functools.reduce(lambda a, b: a & b, pairs)

    every = small(judged)
    out = marked.join(every, match(every), "left_anti")
    again = judged.filter("_stays")
    if again.head(1):
        again = small(again)
        out = out.union(marked.join(again, match(again), "left_semi").dropDuplicates(names))
    return out.drop(*names)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of the session's cluster, and Arrow batches fit for texts."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default; a row here is a whole text
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    out = Path(tempfile.mkdtemp(prefix="quadrille-ship-")) / "quadrille_src.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "quadrille").rglob("*.py")):
            z.write(p, os.path.relpath(p, root))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)


def trim() -> None:
    """Gives memory that is free back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if malloc_trim:
        malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """A function for mapInArrow() that gives memory back when its task ends: workers stay for other stages."""

    def wrapped(batches: Iterable) -> Iterator:
        yield from run(batches)
        trim()

    return wrapped


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Like settle(), but as compressed Parquet: for tables whose size counts."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
