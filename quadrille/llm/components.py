"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def stamp(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())


#: Parts into which a node's pairs are dealt out.
SALTS = 16


def star(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): the least neighbour of u.

    The minimum is aggregated before the exchange. It goes back to SALTS parts of its node, so that a node with a third
    of all pairs doesn't meet them in one task.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least, ["u", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root) for every node that has an edge to another; root is the component's least node.

    Loops and repeated edges don't matter. An empty table gives an empty result.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = settle(e)
    before = stamp(e)
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        down = star(large)
        e = down.select(F.col("u").alias("a"), F.col("m").alias("b")).union(down.filter("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))).distinct()
        e = settle(e)
        after = stamp(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
