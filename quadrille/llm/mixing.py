"""Mixes sources to target weights by hash thresholds.

Every document has a fixed 48-bit hash. Words are summed by source and hash bucket (2 ** 12 buckets at a time); the
running sums of a source show in which bucket its budget ends, and only the documents of that one bucket are summed
again by the next 12 bits. After four levels the budget ends at one hash value. Whole passes over a source (a target
above its size) need no threshold; a nested one decides which documents get one copy more. A document is then taken by
comparing its hash with a number: nothing is sorted and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, settle, small

BITS, LEVELS = 12, 4
MAX_REPEATS = 3


def n_words(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_REPEATS) -> DataFrame:
    """_src, _source_size, _target. sizes has one row per source; that is the number of sources, not of documents.

    The rows are ordered in one task, 100 bytes each: it is meant for up to some millions of sources.

    Sources by code point, null last, get the weights in turn. What a source cannot take beyond ``cap`` times its size
    goes to the others by weight, until none is above. As total size <= cap * total size, this ends with the sources
    whose size per weight is least at their cap: with sources in that order, the running sums give the one level.
    """
    order = Window.orderBy(F.col("_src").isNull(), F.encode(F.col("_src"), "UTF-8"))
    w = sizes.withColumn("_k", (F.row_number().over(order) - 1) % len(weights))
    w = w.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("_k").cast("int") + 1))
    by = Window.orderBy((F.col("_source_size") / F.col("_w")), F.col("_src").isNull(), F.col("_src"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("_total", F.sum("_source_size").over(everything)).withColumn("_ws", F.sum("_w").over(everything))
    w = w.withColumn("_size_before", F.coalesce(F.sum("_source_size").over(before), F.lit(0)))
    w = w.withColumn("_w_before", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    # the share for each unit of weight if all sources before this one are at their cap
    level = (F.col("_total") - cap * F.col("_size_before")) / (F.col("_ws") - F.col("_w_before"))
    w = w.withColumn("_level", level).withColumn("_capped", F.col("_w") * F.col("_level") > cap * F.col("_source_size"))
    # sources stay capped up to the first that is not; from there on the level holds
    w = w.withColumn("_free", F.min(F.when(~F.col("_capped"), F.struct(F.col("_size_before"), F.col("_level")))).over(everything))
    share = F.when(F.col("_free").isNull() | (F.col("_size_before") < F.col("_free._size_before")), cap * F.col("_source_size"))
    share = share.otherwise(F.least(F.lit(float(cap)) * F.col("_source_size"), F.col("_w") * F.col("_free._level")))
    return w.select("_src", "_source_size", share.cast("double").alias("_target"))


def thresholds(base: DataFrame, targets: DataFrame) -> DataFrame:
    """_src, _source_size, _target, _passes (whole copies of all its documents), _limit (hashes below get one more)."""
    passes = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(0)
    state = targets.withColumn("_passes", passes.cast("long"))
    state = state.withColumn("_rest", F.col("_target") - F.col("_passes") * F.col("_source_size"))
    state = state.withColumn("_prefix", F.lit(0).cast("long")).withColumn("_open", F.col("_rest") > 0)
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        rows = base
        if level:
            edge = small(state.filter("_open").select(F.col("_src").alias("_s"), F.col("_prefix").alias("_p")))
            rows = rows.join(edge, F.col("_src").eqNullSafe(F.col("_s")) & (F.shiftright("_hash", shift + BITS) == F.col("_p")), "left_semi")
        hist = rows.groupBy("_src", F.shiftright("_hash", shift).alias("_bucket")).agg(F.sum("_size").alias("_sum"))
        run = Window.partitionBy("_src").orderBy("_bucket")
        hist = hist.withColumn("_upto", F.sum("_sum").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        s = state.filter("_open").select("_src", "_rest").withColumnRenamed("_src", "_s")
        # the first bucket in which the running sum passes the rest of the budget
        over = hist.join(small(s), F.col("_src").eqNullSafe(F.col("_s"))).filter(F.col("_upto") > F.col("_rest"))
        found = over.groupBy("_s").agg(F.min(F.struct("_bucket", "_sum", "_upto")).alias("_b"))
        state = state.join(found, F.col("_src").eqNullSafe(F.col("_s")), "left").drop("_s")
        hit = F.col("_b").isNotNull()
        state = state.withColumn("_rest", F.when(hit, F.col("_rest") - (F.col("_b._upto") - F.col("_b._sum"))).otherwise(F.col("_rest")))
        state = state.withColumn("_prefix", F.when(hit, F.col("_b._bucket")).otherwise(F.col("_prefix")))
        if level == LEVELS - 1:  # one hash value is left: it is taken if that ends nearer to the budget
            state = state.withColumn("_prefix", F.col("_prefix") + F.when(hit & (2 * F.col("_rest") > F.col("_b._sum")), 1).otherwise(0))
        state = settle(state.drop("_b"))  # one row per source
    return state.select("_src", "_source_size", "_target", "_passes", F.when(F.col("_open"), F.col("_prefix")).otherwise(F.lit(0)).alias("_limit"))


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, *keep) -> DataFrame:
    h = F.shiftrightunsigned(F.xxhash64(F.lit(17), F.col(id_col), F.col(text_col)), 16)
    return docs.select(*keep, F.col(source_col).alias("_src"), n_words(F.col(text_col)).alias("_size"), h.alias("_hash"))


def plan(base: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """base needs _src, _size, _hash and is read several times."""
    sizes = settle(base.groupBy("_src").agg(F.sum("_size").cast("long").alias("_source_size")))
    return thresholds(base, source_targets(sizes, weights))


def copies(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds _source_size, _target and _copies. The sources are few enough to be broadcast unless the check says no."""
    lim = small(limits.withColumnRenamed("_src", "_s"))
    out = rows.join(lim, F.col("_src").eqNullSafe(F.col("_s")))
    return out.withColumn("_copies", (F.col("_passes") + F.when(F.col("_hash") < F.col("_limit"), 1).otherwise(0)).cast("int")).drop("_s")


def report(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target, taken.

    Null text: size 0. Null source: a source of its own, last. Rows equal in identifier and text share a hash and are
    taken alike; an empty table gives an empty result.
    """
    base = settle(measured(docs, "doc_id", "text", "source", F.col("doc_id")))
    out = copies(base, plan(base, weights))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns they came with, whatever their names.

    Null and empty texts have no size and are taken like others of their source by their hash; a source of size 0 is not
    taken at all. A null source is one of its own. Rows equal in identifier and text are taken alike. Long texts count
    whole. An empty table gives an empty result.
    """
    base = settle(measured(docs, id_col, text_col, source_col))
    limits = plan(base, weights)
    cols = [F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    out = copies(measured(docs, id_col, text_col, source_col, *cols), limits).filter("_copies > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
