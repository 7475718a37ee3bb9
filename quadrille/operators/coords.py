"""What coordinates say of themselves: whether they ascend or descend, and the bounds of the pixels that they label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def monotonic(rows: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """by, increasing, decreasing: whether the values strictly rise or fall in the order; a single one does both."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    d = rows.select(*by, step.alias("_step")).groupBy(*by)
    return d.agg(F.coalesce(F.bool_and(F.col("_step") > 0), F.lit(True)).alias("increasing"), F.coalesce(F.bool_and(F.col("_step") < 0), F.lit(True)).alias("decreasing"))


def array_bounds(rows: DataFrame, by: Sequence[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    """by, minx, miny, maxx, maxy of evenly spaced top-left labels: the last pixel of an axis is as wide as the others.

    Distinct labels are counted after they were reduced to distinct ones of each axis, which is one exchange.
    """
    axes = rows.select(*by, F.explode(F.array(F.struct(F.lit("x").alias("a"), F.col(x).cast("double").alias("v")), F.struct(F.lit("y").alias("a"), F.col(y).cast("double").alias("v")))).alias("p"))
    axes = axes.select(*by, "p.a", "p.v").distinct()
    pick = lambda f, k: f(F.when(F.col("a") == k, F.col("v")))
    found = axes.groupBy(*by).agg(*[pick(f, k).alias(f"_{n}{k}") for k in "xy" for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))])
    step = lambda k: (F.col(f"_hi{k}") - F.col(f"_lo{k}")) / F.nullif(F.col(f"_n{k}") - 1, F.lit(0))
    return found.select(*by, F.col("_lox").alias("minx"), (F.col("_loy") - step("y")).alias("miny"), (F.col("_hix") + step("x")).alias("maxx"), F.col("_hiy").alias("maxy"))
