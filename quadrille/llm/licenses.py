"""Licence scan by a positional index of rare licence words.

Words are runs of letters and digits after A-Z are lower-cased. Base phrases are counted wherever their words stand
consecutively. Licence texts and notices are found by position. A template's mandatory key phrases must all be there, and
each phrase is filed under its word of highest IDF in the corpus. A file's licence words are looked up there, the rarest
first: each of the file's postings of such a word says where the phrase would begin, and the postings of RARE words of the
phrase are intersected by that place. What is left is verified word for word. A template's phrases then must follow each
other, SLACK words nearer or farther than in the template at most. The words between them, before the first and after the
last are aligned: words of the template that stand in the file in the same order count by their IDF weight, so words that
were put in, left out or changed cost themselves only. Of several places for a phrase the best is taken. Lines with an SPDX
identifier are read as such. IDF counts come from all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import ship
from .license_texts import SPDX_HEAD, SPDX_IDS, SPDX_JOINED, TEMPLATES

#: Fixed values of the contract: phrase and label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Share of a template's IDF weight that must stand in the file, in the template's order.
MIN_SCORE = 0.5
#: Words of a phrase whose postings are intersected.
RARE = 3
#: Words by which the distance of two phrases may differ from the template's, and words by which aligned words may be off.
SLACK = 40


def hash_words(words: Iterable[str]) -> np.ndarray:
    text = [w.encode() for w in words]
    data = np.frombuffer(b" ".join(text), np.uint8)
    return kernel.split(data, np.array([0, len(data)]), kernel.IS_ALNUM).hashes()


@dataclass
class Phrase:
    words: list[int]
    place: int  # in its template
    rare: list[int]  # places in the phrase of its words of highest IDF, the highest first


@dataclass
class Template:
    label: str
    words: np.ndarray
    weights: np.ndarray
    phrases: list[Phrase]
    #: Templates that have all of its phrases and more; where one of them stands, it stands for this one.
    within: list[int]


@dataclass
class Index:
    """Vocabulary (sorted hashes), base phrases and templates in vocabulary numbers."""

    hashes: np.ndarray
    base: list[tuple[list[int], str]]
    templates: list[Template]
    idf: np.ndarray
    #: By a phrase's word of highest IDF: template and phrase.
    filed: dict[int, list[tuple[int, int]]]
    spdx_head: list[int]
    #: By its first word: an identifier's words and its label, the longest first.
    spdx: dict[int, list[tuple[list[int], str]]]
    spdx_joined: set[int]

    def numbers(self, w: kernel.Words) -> np.ndarray:
        """Vocabulary number of every word, or -1."""
        h = w.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def vocabulary(base=BASE, templates=TEMPLATES) -> list[str]:
    texts = [p for p, _ in base] + [t for t, _ in templates.values()] + [p for _, ps in templates.values() for p in ps] + [SPDX_HEAD, *SPDX_IDS, *SPDX_JOINED]
    return sorted({w for t in texts for w in tokens(t)})


def build(n_docs: int, df: dict[str, int], base=BASE, templates=TEMPLATES) -> Index:
    words = vocabulary(base, templates)
    hashes = hash_words(words)
    order = np.argsort(hashes)
    number = {words[j]: i for i, j in enumerate(order.tolist())}
    idf = {w: float(np.log((1 + n_docs) / (1 + df.get(w, 0))) + 1e-3) for w in words}
    made, filed = [], {}
    for label, (text, keys) in templates.items():
        t = tokens(text)
        weights = np.array([idf[w] for w in t])
        phrases, at = [], 0
        for p in map(tokens, keys):
            at = next(i for i in range(at, len(t)) if t[i : i + len(p)] == p)
            phrases.append(Phrase([number[w] for w in p], at, sorted(range(len(p)), key=lambda i: (-idf[p[i]], i))[:RARE]))
            filed.setdefault(phrases[-1].words[phrases[-1].rare[0]], []).append((len(made), len(phrases) - 1))
        within = [j for j, (_, more) in enumerate(templates.values()) if set(keys) < set(more)]
        made.append(Template(label.partition("/")[0], np.array([number[w] for w in t]), weights / weights.sum(), phrases, within))
    spdx: dict[int, list[tuple[list[int], str]]] = {}
    for i in sorted(SPDX_IDS, key=lambda i: -len(tokens(i))):
        said = [number[w] for w in tokens(i)]
        spdx.setdefault(said[0], []).append((said, f"spdx-{i.lower()}"))
    numbered = lambda p: [number[w] for w in tokens(p)]
    weights = np.array([idf[words[j]] for j in order])
    return Index(hashes[order], [(numbered(p), label) for p, label in base], made, weights, filed, numbered(SPDX_HEAD), spdx, {number[w] for w in SPDX_JOINED})


def phrase_places(v: np.ndarray, text: np.ndarray, phrase: list[int]) -> np.ndarray:
    """First words of the places where the phrase's words stand consecutively within one text."""
    n = len(phrase)
    if len(v) < n:
        return np.empty(0, np.int64)
    ok = v[: len(v) - n + 1] == phrase[0]
    for j in range(1, n):
        ok &= v[j : len(v) - n + 1 + j] == phrase[j]
    at = np.flatnonzero(ok)
    return at[text[at] == text[at + n - 1]]


class Postings:
    """Places of every vocabulary word in a group of files."""

    def __init__(self, v: np.ndarray, n_words: int):
        at = np.flatnonzero(v >= 0)
        self.places = at[np.argsort(v[at], kind="stable")]
        self.cuts = np.searchsorted(v[self.places], np.arange(n_words + 1))

    def of(self, word: int) -> np.ndarray:
        return self.places[self.cuts[word] : self.cuts[word + 1]]


def begins(p: Phrase, postings: Postings, v: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where the phrase stands: postings of its rare words meet at one place; then every word is verified."""
    first = postings.of(p.words[p.rare[0]]) - p.rare[0]
    for i in p.rare[1:]:
        if not len(first):
            return first
        other = postings.of(p.words[i]) - i
        first = first[np.isin(first, other, assume_unique=True)]
    n = len(p.words)
    first = first[(first >= 0) & (first + n <= len(v))]
    first = first[text[first] == text[first + n - 1]] if len(first) else first
    for i, w in enumerate(p.words):
        first = first[v[first + i] == w]
    return first


def aligned(t: np.ndarray, weights: np.ndarray, f: np.ndarray, open_end: bool = False) -> float:
    """The largest weight of words of ``t`` that stand in ``f`` in the same order, at most SLACK words off.

    Words that both begin with (or end with, unless the end is open) are taken at once; only what is between is searched.
    """
    n = min(len(t), len(f))
    other = np.flatnonzero(t[:n] != f[:n])
    k = int(other[0]) if len(other) else n
    sure, t, f, w = float(weights[:k].sum()), t[k:], f[k:], weights[k:]
    if not open_end:
        n = min(len(t), len(f))
        other = np.flatnonzero(t[len(t) - n :][::-1] != f[len(f) - n :][::-1])
        k = int(other[0]) if len(other) else n
        sure += float(w[len(t) - k :].sum())
        t, f, w = t[: len(t) - k], f[: len(f) - k], w[: len(t) - k]
    if not len(t) or not len(f):
        return sure
    best = np.zeros(len(f) + 1)  # by how many words of f are used
    off = SLACK + abs(len(t) - len(f)) * (not open_end)
    for i, (x, weight) in enumerate(zip(t.tolist(), w.tolist(), strict=True)):
        a, b = max(0, i - off), min(len(f), i + off + 1)
        if a >= b:
            break
        hit = np.flatnonzero(f[a:b] == x) + a
        if len(hit):
            best[hit + 1] = np.maximum(best[hit + 1], best[hit] + weight)
            np.maximum.accumulate(best[a:], out=best[a:])
    return sure + float(best[-1])


def found(t: Template, starts: list[np.ndarray], v: np.ndarray, text: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, float]]:
    """(text, place of the first phrase, score) wherever all key phrases of a template, which stand at ``starts``, follow each other."""
    known: dict[tuple[int, int], float | None] = {}

    def onwards(k: int, s: int) -> float | None:
        """The weight of what follows from the k-th phrase on, if it stands at s; None if the next phrase is missing."""
        if (k, s) not in known:
            p, of = t.phrases[k], text[s]
            if k + 1 == len(t.phrases):
                words = t.words[p.place :]
                known[k, s] = aligned(words, t.weights[p.place :], v[s : min(bounds[of + 1], s + len(words) + SLACK)], True)
            else:
                q = t.phrases[k + 1]
                at, all_ = s + q.place - p.place, starts[k + 1]
                near = all_[np.searchsorted(all_, max(s + 1, at - SLACK)) : np.searchsorted(all_, at + SLACK, "right")]
                rest = [(c, onwards(k + 1, c)) for c in near.tolist() if text[c] == of]
                part = [x + aligned(t.words[p.place : q.place], t.weights[p.place : q.place], v[s:c]) for c, x in rest if x is not None]
                known[k, s] = max(part, default=None)
        return known[k, s]

    out, head = [], t.phrases[0].place
    for s in starts[0].tolist():
        score = onwards(0, s)
        if score is not None:
            before = v[max(bounds[text[s]], s - head - SLACK) : s]
            score += aligned(t.words[:head][::-1], t.weights[:head][::-1], before[::-1], True)
            if score >= MIN_SCORE:
                out.append((int(text[s]), s, min(1.0, score)))
    return out


def identifiers(index: Index, v: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, str]]:
    """(text, label) for the identifiers of every SPDX line; one that isn't in the list is "spdx"."""
    for s in phrase_places(v, text, index.spdx_head).tolist():
        of, at, some = text[s], s + len(index.spdx_head), False
        while at < len(v) and text[at] == of:
            ids = (i for i in index.spdx.get(int(v[at]), ()) if v[at : at + len(i[0])].tolist() == i[0] and text[min(len(v), at + len(i[0])) - 1] == of)
            hit = next(ids, None)
            if hit is None:
                break
            some = True
            yield int(of), hit[1]
            at += len(hit[0])
            if at < len(v) and int(v[at]) in index.spdx_joined:
                at += 1
            else:
                break
        if not some:
            yield int(of), "spdx"


def document_counts(docs: DataFrame, text_col: str = "text", base=BASE, templates=TEMPLATES) -> tuple[int, dict[str, int]]:
    """Documents, and documents that hold each vocabulary word. Every batch sends one row a vocabulary word at most."""
    words = vocabulary(base, templates)
    index = build(0, {}, base, templates)
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros(len(index.hashes), np.int64), 0
        for batch in batches:
            for a, b, data, bounds in kernel.texts(batch.column(0)):
                w = kernel.split(data, bounds, kernel.IS_ALNUM)
                v = index.numbers(w)
                pair = np.unique(w.text[v >= 0] * len(count) + v[v >= 0])
                count += np.bincount(pair % len(count), minlength=len(count))
                n += b - a
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, np.arange(len(count))]), pa.array(np.r_[n, count])], ["word", "docs"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word long, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    got = {r["word"]: r["docs"] for r in rows}
    order = np.argsort(hash_words(words)).tolist()
    return got.pop(-1, 0), {words[j]: got.get(i, 0) for i, j in enumerate(order)}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the best aligned share of a template's weight, 1 where a base phrase or an SPDX line stands, 0 without any. Null texts
    count as empty: no words, no labels (empty strings), null places. Repeated rows are scanned each; long texts are read
    whole; other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(build(*document_counts(docs, text_col, base, templates), base, templates))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for a, b, data, bounds in kernel.texts(batch.column(1)):
                w = kernel.split(data, bounds, kernel.IS_ALNUM)
                v = index.numbers(w)
                size = b - a
                n_base, low, high = np.zeros(size, np.int64), np.full(size, 1 << 60), np.full(size, -1)
                labels: list[set[str]] = [set() for _ in range(size)]
                for phrase, label in index.base:
                    at = phrase_places(v, w.text, phrase)
                    of, place = w.text[at], at - w.first[w.text[at]]
                    np.add.at(n_base, of, 1)
                    np.minimum.at(low, of, place)
                    np.maximum.at(high, of, place)
                    for t in np.unique(of).tolist():
                        labels[t].add(label)
                base_labels = [",".join(sorted(x)) for x in labels]
                score = np.where(n_base > 0, 1.0, 0.0)
                postings = Postings(v, len(index.hashes))
                starts = [[np.empty(0, np.int64)] * len(t.phrases) for t in index.templates]
                held = np.unique(v[v >= 0])
                for word in held[np.argsort(-index.idf[held], kind="stable")].tolist():
                    for i, k in index.filed.get(word, ()):
                        starts[i][k] = np.sort(begins(index.templates[i].phrases[k], postings, v, w.text))
                hits = [found(t, p, v, w.text, w.first) if all(map(len, p)) else [] for t, p in zip(index.templates, starts, strict=True)]
                there = [{s for _, s, _ in h} for h in hits]
                for i, template in enumerate(index.templates):
                    for t, s, x in hits[i]:
                        if not any(s in there[j] for j in template.within):
                            labels[t].add(template.label)
                            score[t] = max(score[t], x)
                for t, label in identifiers(index, v, w.text):
                    labels[t].add(label)
                    score[t] = 1.0
                none = n_base == 0
                arrays = [batch.column(0).slice(a, size), pa.array(np.diff(w.first)), pa.array(n_base), pa.array(low, mask=none), pa.array(high, mask=none)]
                arrays += [pa.array(base_labels, pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
