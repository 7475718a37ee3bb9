"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio. DataFrame operations only.

Words and pairs of neighbouring words are hashed into BUCKETS features. Two multinomials are counted in one pass: the
raw corpus (every document) and the trusted target (documents that the labels call good). A document's score is the
mean over its features of log p(target) - log p(raw); the target is smoothed towards the raw distribution, so that a
feature the target hardly shows is neither for nor against. Trusted documents are dealt to FOLDS by a hash of their text,
and each is scored against the target without its fold, so that its score doesn't come from its own features or a copy's.

The threshold comes from the scores of all labelled documents, counted in STEPS bins a unit: where the share of good documents
above it exceeds that of bad ones most, but at most LOSS percent of the good ones may fall below. The counts are BUCKETS
rows and the bins a bounded number, whatever the corpus; documents look ratios up in an array of that size, so scoring
takes no exchange. Scores and base columns are stored, without texts, so that the threshold takes no scoring of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored, words

BUCKETS = 1 << 16
#: Prior weight of the raw distribution, in features.
PRIOR = 2000.0
FOLDS = 5
#: Percent of good documents that the threshold may cost.
LOSS = 2
STEPS, MOST = 500, 30
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, REPEAT_PERCENT = 20, 30


def shifted(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def pairs(hashes: Column, by: int = 1) -> Column:
    """Hash of every element with the one ``by`` places on; as many fewer elements."""
    n = F.greatest(F.size(hashes) - by, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), shifted(hashes, by), lambda a, b: F.xxhash64(a, b))


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, words, and the hashes of words (_w) and of pairs (_p)."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    d = d.withColumn("_words", words(F.col("_text")))
    d = d.withColumn("_w", F.transform("_words", lambda w: F.xxhash64(w)))
    return d.withColumn("_p", pairs(F.col("_w")))


def base(d: DataFrame) -> DataFrame:
    """Adds the base columns and base_failed.

    Words in repeated windows: without a repeated window of four words there is none of eight, and only where there is
    one of eight are windows sorted, so that equal neighbours are the repeated ones; the words they cover are the union
    of their ranges. Every step is a column of its own: it is used more than once, and is computed once.
    """
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.withColumn("_lines", lines).withColumn("_four", pairs(F.col("_p"), 2))
    d = d.withColumn("_eight", F.when(F.size(F.array_distinct("_four")) < F.size("_four"), pairs(F.col("_four"), WINDOW - 4)))
    some = F.transform("_eight", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    d = d.withColumn("_sorted", F.when(F.size(F.array_distinct("_eight")) < F.size("_eight"), F.sort_array(some)))
    twice = F.zip_with("_sorted", shifted(F.col("_sorted"), 1), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    d = d.withColumn("_at", F.sort_array(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull())))))
    gaps = F.zip_with("_at", shifted(F.col("_at"), 1), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    d = d.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g), F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def features(d: DataFrame) -> Column:
    """Words fill the lower half of the buckets and pairs the upper."""
    half = BUCKETS // 2
    return F.concat(F.transform("_w", lambda h: F.pmod(h, F.lit(half)).cast("int")), F.transform("_p", lambda h: (F.pmod(h, F.lit(half)) + half).cast("int")))


def marked(d: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds _quality: 1 for trusted documents, 0 for those labelled bad and never good, null for others; and _fold."""
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_quality"))
    marks = small(marks.filter("_id IS NOT NULL AND _quality IN (0, 1)").groupBy("_id").agg(F.max("_quality").alias("_quality")))
    d = d.join(marks, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    return d.withColumn("_fold", F.when(F.col("_quality") == 1, F.pmod(F.xxhash64("_text"), F.lit(FOLDS))))


def counts(d: DataFrame) -> list[tuple[int, ...]]:
    """(bucket, number in all documents, number in trusted ones by fold): at most BUCKETS rows, counted before the exchange."""
    rows = d.select("_fold", F.explode(features(d)).alias("bucket"))
    by_fold = [F.count_if(F.col("_fold") == k).alias(f"good{k}") for k in range(FOLDS)]
    return [tuple(r) for r in rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), *by_fold).collect()]


def looked_up(values: list[float]) -> Callable[[Column], Column]:
    """A constant array of BUCKETS values; it is part of the plan, as one folded literal."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in values)), ",").cast("array<double>")
    return lambda bucket: F.get(table, bucket)


class Ratios:
    """Scores of documents by the log-ratios of their features: against the whole target, or without a fold of it."""

    def __init__(self, found: list[tuple[int, ...]], prior: float = PRIOR):
        raw, good = [0] * BUCKETS, [[0] * FOLDS for _ in range(BUCKETS)]
        for b, r, *g in found:
            raw[b], good[b] = r, g
        self.tables = [looked_up(self.ratios(raw, [sum(g) - (g[k] if k >= 0 else 0) for g in good], prior)) for k in range(-1, FOLDS)]

    @staticmethod
    def ratios(raw: list[int], good: list[int], prior: float) -> list[float]:
        raw_all, good_all = float(max(1, sum(raw))), sum(good)
        return [math.log((g * raw_all / r + prior) / (good_all + prior)) if r else 0.0 for r, g in zip(raw, good, strict=True)]

    def scored(self, d: DataFrame) -> DataFrame:
        """Adds llr."""
        d = d.withColumn("_f", features(d)).withColumn("_n", F.size("_f"))

        def summed(table: Callable[[Column], Column]) -> Column:
            return F.aggregate("_f", F.lit(0.0), lambda s, b: s + table(b))

        mean = [summed(t) / F.col("_n") for t in self.tables]
        score = F.when(F.col("_n") == 0, F.lit(0.0))
        for k in range(FOLDS):
            score = score.when(F.col("_fold") == k, mean[k + 1])
        return d.withColumn("llr", score.otherwise(mean[0])).drop("_f", "_n")


def cut(bins: list[tuple[int, int, int]], loss: int = LOSS) -> float | None:
    """The threshold for (bin, good documents, bad ones): None without good ones.

    Between two bins with documents every threshold does the same; the middle is taken. Without bad documents it is the
    highest that the loss allows; else, of equal ones, the lowest.
    """
    bins = sorted(x for x in bins if x[1] or x[2])
    good, bad = sum(g for _, g, _ in bins), sum(b for *_, b in bins)
    if not good:
        return None
    best, at, below_good, below_bad, before = None, 0.0, 0, 0, bins[0][0] - 1
    for k, g, b in bins:
        if 100 * below_good > loss * good:
            break
        gain = below_bad * good - below_good * bad if bad else below_good
        if best is None or gain > best:
            best, at = gain, (before + 1 + k) / 2
        below_good, below_bad, before = below_good + g, below_bad + b, k
    return at / STEPS


def threshold(rows: DataFrame) -> float | None:
    """From all labelled rows that pass the base rules. rows: base_failed, llr, _quality."""
    at = F.floor(F.least(F.greatest("llr", F.lit(-MOST)), F.lit(MOST)) * STEPS).cast("int")
    known = rows.filter(~F.col("base_failed") & F.col("_quality").isNotNull())
    bins = known.groupBy(at.alias("bin")).agg(F.count_if(F.col("_quality") == 1).alias("good"), F.count_if(F.col("_quality") == 0).alias("bad"))
    return cut([tuple(r) for r in bins.collect()])


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR) -> DataFrame:
    """One row per input row: doc_id, the base columns, base_failed, llr, kept. labels: doc_id, quality (0 or 1).

    Null and empty texts have no words and fail the base rules. Rows that repeat an identifier are scored each, with the
    label of that identifier; conflicting labels count as good, null ones as none. Long texts are read whole. Other
    columns, whatever their names, are not read. Without good documents the base rules alone decide. An empty table
    gives an empty result.
    """
    d = marked(measured(docs, id_col, text_col), labels)
    rows = base(Ratios(counts(d), prior).scored(d))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr"]
    rows = stored(rows.select(*columns, "_quality"), "quality")
    least = threshold(rows)
    kept = ~F.col("base_failed") & (F.lit(True) if least is None else F.col("llr") >= least)
    return rows.select(*columns, kept.alias("kept"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, labels)
