"""Toxicity by cumulative-link ordinal regression: P(severity <= k) = sigmoid(cut_k - w.x), one w for all cuts.

x marks which of the model's words a text holds (runs of letters and digits, A-Z lower-cased), and which word beginnings
of a few lengths it holds in one, two, or three or more places, for words that are inflected or compounded. The model
is fitted on at most SAMPLE labelled documents, which is a parameter; every document is scored, over its whole text. Labels that
only say toxic or not are graded by how many distinct marker words a toxic document holds: the grades are 0 (not
toxic), 1, 2 and 3, the last three cut at the terciles of the labelled toxic documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .common import ship, stored, trim, trimmed

SAMPLE = 5_000
GRADES = 3
#: Bytes of a word's beginning, and in how many places it counts as a feature of its own.
STEMS, PLACES = (5, 6, 7), 3
#: A word is a feature if so many distinct sampled documents hold it, its log odds are so many standard errors from 0,
#: and most documents that hold it are on the side that it speaks for.
MIN_DOCS, MIN_Z, MIN_SHARE = 5, 4.0, 0.6
#: Features of a model, those farthest from 0 in standard errors. With SAMPLE it bounds what the driver gets.
FEATURES = 20_000


def features(data: np.ndarray, bounds: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) of a group of texts, sorted; with ``known`` (sorted), of these features only."""
    w = kernel.split(data, bounds, kernel.IS_ALNUM)
    texts, found = [], []
    for most in (0, *STEMS):
        at = np.flatnonzero(w.end - w.start > most)
        h = kernel.mix(w.hashes(most)[at] + np.uint64(most))
        text = w.text[at]
        if known is not None:  # the feature of one place has the name of its beginning
            keep = np.isin(h, known)
            h, text = h[keep], text[keep]
        if not most:
            texts.append(text)
            found.append(h)
            continue
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        run = np.arange(len(h))
        new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])] if len(h) else np.empty(0, bool)
        nth = run - np.maximum.accumulate(np.where(new, run, 0))
        for j in range(PLACES):
            texts.append(text[nth == j])
            found.append(h[nth == j] + np.uint64(j))
    text, feature = np.concatenate(texts), np.concatenate(found)
    order = np.lexsort((feature, text))
    text, feature = text[order], feature[order]
    new = np.r_[True, (feature[1:] != feature[:-1]) | (text[1:] != text[:-1])] if len(text) else np.empty(0, bool)
    return text[new], feature[new]


@dataclass
class Model:
    words: np.ndarray  # sorted 64-bit features
    weights: np.ndarray
    cuts: np.ndarray  # ascending; none if there was nothing to learn from

    @property
    def names(self) -> np.ndarray:
        """Word hashes of which the features may be: a beginning in j + 1 places is j above it."""
        return np.unique(np.concatenate([self.words - np.uint64(j) for j in range(PLACES)]))

    def above(self, eta: np.ndarray) -> np.ndarray:
        """P(severity > k) by row and cut."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - eta[:, None], -40, 40)))

    def eta(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bounds) - 1)
        if len(self.words):
            text, feature = features(data, bounds, self.names)
            at = np.minimum(np.searchsorted(self.words, feature), len(self.words) - 1)
            hit = self.words[at] == feature
            np.add.at(out, text[hit], self.weights[at[hit]])
        return out


def feature_lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) -> (label, features)."""
    for batch in batches:
        for a, b, data, bounds in kernel.texts(batch.column(1)):
            text, feature = features(data, bounds)
            offsets = np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32)
            flat = feature.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["label", "words"])


def graded(label: np.ndarray, row: np.ndarray, marker: np.ndarray, grades: int) -> np.ndarray:
    """Severity of binary labels from the distinct marker words of a row."""
    n = np.bincount(row[marker], minlength=len(label))
    cuts = np.quantile(n[label > 0], np.arange(1, grades) / grades) if (label > 0).any() else np.zeros(grades - 1)
    return np.where(label > 0, 1 + (n[:, None] > cuts[None, :]).sum(1), 0)


def fit_rows(label: np.ndarray, row: np.ndarray, words: np.ndarray, col: np.ndarray, marker: np.ndarray, grades: int = GRADES, steps: int = 2000) -> Model:
    """label by row; (row, col) tells which of the words a row holds; marker which of them speak for toxic texts.

    Labels 0 and 1 are graded; others are severities as they stand.
    """
    if not len(words):
        return Model(np.empty(0, np.uint64), np.empty(0), np.empty(0))
    severity = graded(label, row, marker[col], grades) if label.max() == 1 else label
    k = int(severity.max())
    over = (severity[:, None] > np.arange(k)[None, :]).astype(float)
    w, low, gaps = np.zeros(len(words)), np.array([2.0]), np.zeros(k - 1)
    params = [w, low, gaps]
    m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for t in range(1, steps + 1):  # Adam on the ordinal likelihood with a small ridge
        cuts = low[0] + np.r_[0, np.cumsum(np.exp(gaps))]
        eta = np.bincount(row, weights=w[col], minlength=len(label))
        d = (1 / (1 + np.exp(np.clip(cuts[None, :] - eta[:, None], -40, 40))) - over) / len(label)
        by_cut = -d.sum(0)
        grad = [np.bincount(col, weights=d.sum(1)[row], minlength=len(w)) + 2e-6 * w, np.array([by_cut.sum()]), np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(gaps)]
        for i, (x, g) in enumerate(zip(params, grad, strict=True)):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            x -= 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-9)
    order = np.argsort(words)
    return Model(words[order], w[order], low[0] + np.r_[0, np.cumsum(np.exp(gaps))])


def chosen(rows: DataFrame, most: int = FEATURES) -> DataFrame:
    """(word, marker) of the sample's features that the model uses; rows: label, words."""
    toxic = F.col("label") > 0
    p, n = (float(x or 0) for x in rows.agg(F.count_if(toxic), F.count_if(~toxic)).head())
    c = rows.select(F.explode("words").alias("word"), toxic.alias("t")).groupBy("word").agg(F.count_if("t").alias("pos"), F.count_if(~F.col("t")).alias("neg"))
    c = c.filter((F.col("pos") + F.col("neg") >= MIN_DOCS) & F.lit(bool(p and n)))
    a, b, x, y = F.col("pos") + 0.5, p - F.col("pos") + 0.5, F.col("neg") + 0.5, n - F.col("neg") + 0.5
    c = c.withColumn("odds", F.ln(a / b) - F.ln(x / y)).withColumn("z", F.abs("odds") / F.sqrt(1 / a + 1 / b + 1 / x + 1 / y))
    side = F.when(F.col("odds") > 0, F.col("pos")).otherwise(F.col("neg"))
    c = c.filter((F.col("z") >= MIN_Z) & (side >= MIN_SHARE * (F.col("pos") + F.col("neg"))))
    return c.orderBy(F.desc("z"), "word").limit(most).select("word", (F.col("odds") > 0).alias("marker"))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """labels: doc_id and the label. The sample is the labelled documents with the least hashes, the same in any run.

    Null labels and identifiers are left out; of repeated ones the highest label counts, as it does for texts with the
    same features, which count once. Of different texts with one identifier that with the least hash counts. Features are counted and chosen in Spark; the driver gets the labels and which of
    at most FEATURES features each of at most ``sample`` documents holds. Without both kinds of labels nothing is learnt.
    """
    ship(docs.sparkSession)
    picked = labels.select(F.col("doc_id").cast("long").alias("_l"), F.col(label_col).cast("int").alias("_y")).filter("_l IS NOT NULL AND _y IS NOT NULL")
    picked = picked.groupBy("_l").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_l"), "_l").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.join(F.broadcast(picked), F.col("_id") == F.col("_l"))  # at most ``sample`` rows
    one = F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text"))).alias("one")
    rows = rows.groupBy("_l").agg(F.first("_y").alias("_y"), one).select("_y", F.col("one._text").alias("_text"))
    rows = rows.mapInArrow(trimmed(feature_lists), "label int, words array<long>")
    rows = rows.select(F.monotonically_increasing_id().alias("id"), "label", F.xxhash64("words").alias("row"), F.size("words").alias("n"), "words")
    rows = stored(rows, "sample")
    once = rows.groupBy("row", "n").agg(F.max("label").alias("label"), F.min("id").alias("id"))  # without the words
    rows = rows.drop("label").join(F.broadcast(once.select("id", "label")), "id").select("row", "n", "label", "words")
    found = chosen(rows).toPandas().sort_values("word")
    marks = rows.sparkSession.sparkContext.broadcast(found["word"].to_numpy(np.int64))

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            of = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
            flat = np.asarray(lists.flatten(), np.int64)
            col = np.searchsorted(marks.value, flat)
            hit = np.append(marks.value, 0)[col] == flat
            hit &= col < len(marks.value)
            cuts = np.searchsorted(of[hit], np.arange(len(lists) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.ListArray.from_arrays(pa.array(cuts), pa.array(col[hit].astype(np.int32)))], ["row", "n", "label", "cols"])

    got = rows.select("row", "n", "label", "words").mapInArrow(held, "row long, n int, label int, cols array<int>").toArrow()
    got = got.sort_by([("row", "ascending"), ("n", "ascending")]).combine_chunks()  # in whatever order tasks end
    label = np.asarray(got["label"], np.int64)
    lists = got["cols"].combine_chunks() if len(label) else pa.array([], pa.list_(pa.int32()))
    row = np.repeat(np.arange(len(label)), np.asarray(pc.list_value_length(lists)))
    model = fit_rows(label, row, found["word"].to_numpy(np.int64).view(np.uint64), np.asarray(lists.flatten(), np.int64), found["marker"].to_numpy(bool))
    del got, lists, row, label
    trim()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, severity (expected), p_toxic, grade (most likely), toxic, kept.

    Null and empty texts hold no words and are not toxic unless most labelled documents are; a model that had nothing to
    learn from calls nothing toxic. Repeated rows are scored each. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, data, bounds in kernel.texts(batch.column(1)):
                over = m.above(m.eta(data, bounds))
                p = over[:, 0] if over.shape[1] else np.zeros(b - a)
                ladder = np.c_[np.ones(b - a), over, np.zeros(b - a)]
                grade = np.argmax(ladder[:, :-1] - ladder[:, 1:], axis=1).astype(np.int32)
                arrays = [batch.column(0).slice(a, b - a), pa.array(over.sum(1)), pa.array(p), pa.array(grade), pa.array(p >= 0.5), pa.array(p < 0.5)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "severity", "p_toxic", "grade", "toxic", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean, kept boolean")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that are not toxic, with all their columns, whatever their names.

    Null and empty texts stay unless most labelled documents are toxic; repeated rows stay or go together; long texts
    are read whole. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            stay = [np.zeros(0, bool)]
            for _, _, data, bounds in kernel.texts(batch.column(at)):
                over = m.above(m.eta(data, bounds))
                stay.append(over[:, 0] < 0.5 if over.shape[1] else np.ones(len(bounds) - 1, bool))
            yield batch.filter(pa.array(np.concatenate(stay)))

    schema = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(names, docs.schema.fields, strict=True)])
    return docs.toDF(*names).mapInArrow(trimmed(run), schema).toDF(*docs.columns)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
