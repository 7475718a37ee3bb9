"""Reductions and calendar resampling. NULLs are skipped; every one is a single partially aggregated shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import materialised

#: Ranks that are looked for at a time and may be broadcast.
BROADCAST_RANKS = 100_000
HOWS = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def reduce(px: DataFrame, over_rest: Sequence[str], how: str, value: str = "v", out: str | None = None) -> DataFrame:
    """Reduces to the dimensions ``over_rest``; none of them gives the one value of the whole stack.

    A median of groups that aren't single pixels, and so can be of any size, is selected without gathering a group.
    """
    if how == "median" and not {"iy", "ix"} <= set(over_rest):
        every = px.select(*over_rest).distinct() if over_rest else px.sparkSession.range(1).select()
        found = quantiles(px, [0.5], over_rest, value).drop("q").withColumnRenamed(value, out or value)
        return every.join(found, list(over_rest), "left") if over_rest else every.join(found, how="left")
    return px.groupBy(*over_rest).agg(HOWS[how](value).alias(out or value))


def week(t: Column) -> Column:
    """The Sunday that ends a Monday-to-Sunday week."""
    return F.date_trunc("week", t).cast("timestamp_ntz") + F.expr("INTERVAL 6 DAYS")


def month(t: Column) -> Column:
    return F.date_trunc("month", t).cast("timestamp_ntz")


RULES = {"1w": (week, "INTERVAL 7 DAYS"), "MS": (month, "INTERVAL 1 MONTH")}


def resample(px: DataFrame, rule: str, how: str, by: Sequence[str] = (), time: str = "t", value: str = "v", out: str = "v", gaps: bool = False) -> DataFrame:
    """Calendar buckets; with ``gaps`` every bucket between the first and the last has a row, empty ones with NULL."""
    label, step = RULES[rule]
    got = reduce(px.select(label(F.col(time)).alias("bucket"), *by, F.col(value)), ["bucket", *by], how, value, out)
    if not gaps:
        return got
    span = px.agg(F.min(label(F.col(time))).alias("a"), F.max(label(F.col(time))).alias("b"))  # one row
    grid = span.select(F.explode(F.expr(f"sequence(a, b, {step})")).alias("bucket"))
    for c in by:
        grid = grid.crossJoin(F.broadcast(px.select(c).distinct()))  # labels of a dimension
    return grid.join(got, ["bucket", *by], "left")


#: Bins in which a round counts the values that may have a rank.
BINS = 1024


def quantiles(px: DataFrame, qs: Sequence[float], by: Sequence[str] = (), value: str = "v") -> DataFrame:
    """(by, q, value): exact quantiles with linear interpolation of groups of any size, by distributed selection.

    NULL and NaN don't count; a group without values has no row. A round counts, for each rank that is looked for, the
    values of every bin of the range it may lie in, and goes on within the bin that holds the rank, from its least to its
    greatest value, until these are equal. So what is shuffled is one row a bin and task, never the values.
    """
    v = F.col(value).cast("double")
    by = list(by)
    px = px.select(*by, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    group = px.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    group = materialised(group.filter("_n > 0"))
    place = group.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("_at", F.col("q") * (F.col("_n") - 1))
    ranks = place.select(*by, "q", "_at", F.floor("_at").alias("_k"), F.ceil("_at").alias("_k2"))
    todo = group.join(ranks.select(*by, F.explode(F.array("_k", "_k2")).alias("_k")).distinct(), by) if by else group.crossJoin(F.broadcast(ranks.select(F.explode(F.array("_k", "_k2")).alias("_k")).distinct()))
    todo = materialised(todo.select(*by, "_k", "_lo", "_hi", F.lit(0).cast("long").alias("_before")))
    done = todo.filter("_lo = _hi")
    todo = todo.filter("_lo < _hi")
    while todo.head(1):
        wanted = F.broadcast(todo) if todo.count() <= BROADCAST_RANKS else todo
        hit = (px.join(wanted, by) if by else px.crossJoin(wanted)).filter("_v >= _lo AND _v <= _hi")
        v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
        share = F.when(hi - lo < float("inf"), (v - lo) / (hi - lo)).otherwise((v / 2 - lo / 2) / (hi / 2 - lo / 2))
        binned = hit.groupBy(*by, "_k", "_before", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        so_far = F.sum("_n").over(Window.partitionBy(*by, "_k").orderBy("_bin"))  # at most BINS rows
        now = binned.withColumn("_to", F.col("_before") + so_far).withColumn("_before", F.col("_to") - F.col("_n"))
        now = materialised(now.filter("_before <= _k AND _k < _to").select(*by, "_k", "_lo", "_hi", "_before"))
        done = done.unionByName(now.filter("_lo = _hi"))
        todo = now.filter("_lo < _hi")
    found = done.select(*by, "_k", F.col("_lo").alias("_x"))
    out = ranks.join(found, [*by, "_k"]).join(found.withColumnsRenamed({"_k": "_k2", "_x": "_y"}), [*by, "_k2"])
    return out.select(*by, "q", (F.col("_x") + (F.col("_y") - F.col("_x")) * (F.col("_at") - F.col("_k"))).alias(value))


def percentiles(px: DataFrame, qs: Sequence[float] = (0.02, 0.98), value: str = "v", exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """Display range by a mergeable sketch, or exact by distributed selection."""
    name = lambda q: f"p{round(q * 100)}"
    if not exact:
        return px.agg(F.percentile_approx(value, list(qs), accuracy).alias("q")).select(*[F.col("q")[i].alias(name(q)) for i, q in enumerate(qs)])
    rows = quantiles(px, qs, value=value)
    return rows.agg(*[F.max(F.when(F.col("q") == float(q), F.col(value))).alias(name(q)) for q in qs])  # one row a quantile
