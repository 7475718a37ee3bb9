"""Raster views over the star-schema tables: pixels, scenes, assets and blocks, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels_of(table(spark, sf_dir, "lineitem"))


def pixels_of(d: DataFrame) -> DataFrame:
    return d.select(
        F.col("l_shipdate").alias("t"),
        F.col("l_orderkey").alias("item"),
        F.col("l_returnflag").alias("band"),
        F.pmod("l_suppkey", F.lit(SIDE)).cast("int").alias("iy"),
        F.pmod("l_partkey", F.lit(SIDE)).cast("int").alias("ix"),
        F.col("l_quantity").alias("raw"),
        F.when(F.col("l_discount") != 0, F.col("l_quantity")).alias("v"),
        # one number, which keeps aggregates by it in fixed-width buffers: 5 digits of days, then 12, 1, 10 and 9
        F.expr(f"cast(datediff(l_shipdate, DATE'1900-01-01') AS decimal(5,0)) * {10**32}BD + cast(l_orderkey AS decimal(12,0)) * {10**20}BD + cast(l_linenumber AS decimal(1,0)) * {10**19}BD + cast(l_partkey AS decimal(10,0)) * {10**9}BD + cast(l_suppkey AS decimal(9,0))").alias("ord"),
    )


PX = """px AS (SELECT l_shipdate AS t, l_orderkey AS item, l_returnflag AS band, (l_suppkey % 32)::INT AS iy, (l_partkey % 32)::INT AS ix,
  l_quantity AS raw, CASE WHEN l_discount <> 0 THEN l_quantity END AS v,
  row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ord FROM lineitem)"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders")
    lon, lat = F.pmod("o_orderkey", F.lit(359)) - 180.0, F.pmod("o_custkey", F.lit(159)) - 80.0
    return d.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("dt"),
        F.pmod("o_custkey", F.lit(100)).cast("int").alias("cloud"),
        (F.pmod("o_custkey", F.lit(2)) + 32613).cast("int").alias("epsg"),
        F.col("o_totalprice").alias("size"),
        lon.alias("minx"),
        lat.alias("miny"),
        (lon + 1).alias("maxx"),
        (lat + 1).alias("maxy"),
    )


SC = """scenes AS (SELECT o_orderkey AS id, o_orderdate AS dt, (o_custkey % 100)::INT AS cloud, (32613 + o_custkey % 2)::INT AS epsg, o_totalprice AS size,
  (-180 + o_orderkey % 359)::DOUBLE AS minx, (-80 + o_custkey % 159)::DOUBLE AS miny, (-179 + o_orderkey % 359)::DOUBLE AS maxx, (-79 + o_custkey % 159)::DOUBLE AS maxy FROM orders)"""

#: Media type of an asset by its number; fixed values of the view.
TYPES = ("image/tiff; application=geotiff", "image/jp2", "application/json", "image/tiff", None)


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events")
    k = F.pmod("event_id", F.lit(5))
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), k.cast("int") + 1)
    n = F.get_json_object("props", "$.k").cast("int")
    return d.select(
        F.col("event_id").alias("ordinal"),
        F.col("user_id").alias("item"),
        F.col("event_type").alias("asset"),
        F.when(F.col("event_type") == "error", "text/html").when(F.col("event_type") == "view", F.element_at(F.array(*map(F.lit, ("image/tiff; application=geotiff", "image/jp2"))), F.pmod("event_id", F.lit(2)).cast("int") + 1)).otherwise(kind).alias("type"),
        F.concat(F.lit("mem://"), F.col("event_id").cast("string")).alias("href"),
        (1.0 + n / 100.0).alias("scale"),
        n.cast("double").alias("offset"),
        F.col("ts"),
        F.col("value"),
    )


AS = """assets AS (SELECT event_id AS ordinal, user_id AS item, event_type AS asset,
  CASE WHEN event_type = 'error' THEN 'text/html' WHEN event_type = 'view' THEN CASE event_id % 2 WHEN 0 THEN 'image/tiff; application=geotiff' ELSE 'image/jp2' END
   ELSE CASE event_id % 5 WHEN 0 THEN 'image/tiff; application=geotiff' WHEN 1 THEN 'image/jp2' WHEN 2 THEN 'application/json' WHEN 3 THEN 'image/tiff' END END AS type,
  'mem://' || event_id AS href, 1.0::DOUBLE + json_extract(props, '$.k')::INT / 100.0::DOUBLE AS scale, json_extract(props, '$.k')::INT::DOUBLE AS "offset", ts, value FROM events)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings")
    return d.select(F.col("vec_id").alias("time_idx"), F.col("label").alias("band"), F.col("embedding").alias("data"))


BL = "blocks AS (SELECT vec_id AS time_idx, label AS band, embedding AS data FROM embeddings)"
