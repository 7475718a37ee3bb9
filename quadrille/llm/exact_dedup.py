"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Every row gets a digest (SHA-256, a second 64-bit hash and the byte length of the normalised text). The rows of an input
partition are a run: sorted by digest, with equal digests as one entry that holds the identifier to keep and a count.
The RADIX ** ROUNDS runs then meet in binomial rounds: in round r, the RADIX runs whose numbers differ in digit r only
exchange entries, each by its digest, merge them in order, and keep one entry for equal ones. After the last round a
digest has one entry. A text that fills a third of the corpus thus meets in pieces: no task ever gets more than RADIX
entries of it. The kept identifier then goes to the first runs, once for each run that has the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, only_kept, same, stored

RADIX, ROUNDS = 4, 4


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def digest(text: Column) -> Column:
    """48 bytes; equal ones agree in SHA-256, in an unrelated 64-bit hash and in length: a verified match."""
    check = F.concat(F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))
    return F.unhex(F.concat(F.sha2(text.cast("binary"), 256), check))


def merge(entries: DataFrame, *key: str) -> DataFrame:
    """One round. max() of a struct makes Spark aggregate by sorting: sorted runs in, one merged sorted run out."""
    return entries.groupBy("_dig", *key).agg(F.max("_best").alias("_best"), F.sum("_n").alias("_n"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per input row: _id, _dig, _keep (identifier that stays), _n (rows with this text).

    Null texts count as empty. Null identifiers never stay if the text has another one. Repeated rows (same identifier
    and text) count once each in _n. An empty table gives an empty result.
    """
    sign = 1 if keep == "largest" else -1
    # the normalised text is a projection of its own, so that it is computed once
    leaf = docs.select(F.col(id_col).cast("long").alias("_id"), normalised(F.col(text_col)).alias("_text"))
    leaf = leaf.select("_id", digest(F.col("_text")).alias("_dig"))
    leaf = leaf.withColumn("_run", F.spark_partition_id() % RADIX**ROUNDS)
    leaf = stored(leaf, "digests")  # texts are read once; the merges and the last join read 60 bytes a row
    first = leaf.groupBy("_dig", "_run").agg(F.max(F.struct((F.col("_id") * sign).alias("k"))).alias("_best"), F.count(F.lit(1)).alias("_n"))
    level = first
    for r in range(ROUNDS - 1, 0, -1):
        level = merge(level.withColumn("_part", (F.col("_run") % RADIX**r).cast("int")), "_part").withColumnRenamed("_part", "_run")
    top = merge(level).select("_dig", (F.col("_best.k") * sign).alias("_keep"), "_n")
    down = first.select("_dig", "_run").join(top, "_dig")
    return leaf.join(down, ["_dig", "_run"]).select("_id", "_dig", "_keep", "_n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows that stay, with all their columns, whatever their names.

    Of equal texts the row with the largest (or smallest) identifier stays, null ones only if there is no other; of rows
    that repeat both, one. Null texts count as empty, and so all but one of them go. An empty table gives an empty result.
    """
    rows = groups(docs, id_col, text_col, keep).groupBy("_id", "_dig").agg(F.count(F.lit(1)).alias("_times"), F.max("_keep").alias("_keep"))
    judged = rows.select("_id", "_dig", same(F.col("_id"), F.col("_keep")).alias("_stays"), "_times").filter("NOT _stays OR _times > 1").drop("_times")
    return only_kept(docs, [docs[id_col].cast("long"), digest(normalised(docs[text_col]))], stored(judged, "judged"))


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of every document, those that go included."""
    return groups(docs).select(
        F.col("_id").alias("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_n").cast("long").alias("group_size"),
        same(F.col("_id"), F.col("_keep")).alias("kept"),
        F.lower(F.hex(F.substring("_dig", 1, 32))).alias("text_sha256"),
    )


ORACLE = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""
