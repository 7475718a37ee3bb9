"""Spelling variants: words one edit apart, each under its most frequent variant, by a symmetric-delete join.

Every word emits itself and its distinct single deletions. Two words that differ by one inserted, deleted or replaced
code point share exactly one of these keys, so an equality join finds every such pair once; a shared key is then verified
by the exact distance. A key is held by the words that one insertion makes of it and itself, so the size of its group is
bounded by the alphabet and the word's length, not by the input.

Keys are 64-bit hashes, worked out for all deletions of a word in time that grows with its length, not with its square.
Words of at most LONG code points travel with their keys; of longer ones only the number does, and their texts are joined
to the pairs that are left.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import settle, ship, stored, trimmed

#: Words up to so many code points are part of their keys' rows.
LONG = 48
#: Different words that a task counts at a time.
HELD = 200_000
#: Words whose keys are made at a time.
GROUP = 4096


@dataclass(frozen=True)
class Spec:
    """Which runs of letters count as words, and how much more frequent a form must be."""

    #: What stands in a class of a regular expression.
    letters: str = "A-Za-zÀ-ÿ"
    least_length: int = 5
    least_count: int = 3
    ratio: int = 2
    #: Of so many (document, word) pairs one has a misspelling put in, by a checksum; 0: none.
    misspell: int = 0


def word_counts(docs: DataFrame, spec: Spec = Spec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of all texts, with only A-Z lower-cased, that are long and frequent enough.

    With ``misspell``, a word loses one code point where the CRC-32 of "document:word" is a multiple of it: the one at the
    checksum's remainder by the word's length. Null and empty texts have no words. A null identifier counts as an empty
    one. Repeated rows count each. Other columns, whatever their names, are not read. A task counts up to HELD different
    words before it hands them on, so texts and tables of any size take bounded memory.
    """
    ship(docs.sparkSession)
    runs = re.compile(f"[{spec.letters}]{{{spec.least_length},}}")
    every = spec.misspell

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                found = runs.findall((text.as_py() or b"").lower().decode())  # of bytes, lower() changes A-Z only
                if every:
                    so_far = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for i, word in enumerate(found):
                        h = zlib.crc32(word.encode(), so_far)
                        if h % every == 0:
                            at = h % len(word)
                            found[i] = word[:at] + word[at + 1 :]
                seen.update(found)
                if len(seen) > HELD:
                    yield counted()
        yield counted()

    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(trimmed(run), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter((F.char_length("word") >= spec.least_length) & (F.col("n") >= spec.least_count))


def key_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word's place in the list, key): each word's own hash and those of its distinct single deletions.

    A hash is a sum over code points, each weighted by a power of its place; a deletion moves what follows one place down.
    Deleting any of a run of equal code points gives the same word, so only the run's first is deleted.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - first[word]
    up, down = kernel.powers(int(lengths.max(initial=0)) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(kernel.mix(codes + np.uint64(kernel.BASE)) * up[place], out=sums[1:])
    whole = sums[first + lengths] - sums[first]
    begins = np.ones(len(codes), bool)
    begins[1:] = (codes[1:] != codes[:-1]) | (word[1:] != word[:-1])
    at, w = np.flatnonzero(begins), word[begins]
    rest = (sums[first[w] + lengths[w]] - sums[at + 1]) * down[1]
    shorter = sums[at] - sums[first[w]] + rest
    seal = lambda h, n: kernel.mix(h + kernel.mix(n.astype(np.uint64)))
    keys = np.concatenate([seal(whole, lengths), seal(shorter, lengths[w] - 1)])
    return np.concatenate([np.arange(len(words)), w]), keys.view(np.int64)


def keys_of(words: DataFrame, with_text: bool) -> DataFrame:
    """key, id, n (and word) for every key of every word."""
    ship(words.sparkSession)
    names = ["key", "id", "n"] + ["word"] * with_text

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, GROUP):
                part = batch.slice(a, GROUP)
                word, key = key_hashes(part.column("word").to_pylist())
                for b in range(0, len(key), 16 * GROUP):
                    at = pa.array(word[b : b + 16 * GROUP])
                    yield pa.RecordBatch.from_arrays([pa.array(key[b : b + 16 * GROUP]), *[part.column(c).take(at) for c in names[1:]]], names)

    return words.select("id", "n", "word").mapInArrow(trimmed(run), "key long, id long, n long" + ", word string" * with_text)


def joined(keys: DataFrame) -> DataFrame:
    """Pairs of different words that share a key: a_id, a_n, b_id, b_n (a_word, b_word)."""
    rest = [c for c in keys.columns if c != "key"]
    a, b = (keys.select("key", *[F.col(c).alias(f"{side}_{c}") for c in rest]) for side in "ab")
    return a.join(b, "key").filter("a_id < b_id").drop("key")


def near_pairs(words: DataFrame) -> DataFrame:
    """words (id, word, n; unique) -> a_id, a_n, a_word, b_id, b_n, b_word for every two words at distance one, once."""
    one = F.levenshtein("a_word", "b_word", 1) == 1
    short = joined(keys_of(words.filter(F.char_length("word") <= LONG), True)).filter(one)
    long = words.filter(F.char_length("word") >= LONG)
    if not long.filter(F.char_length("word") > LONG).head(1):
        return short
    texts = long.select("id", "word")
    found = joined(keys_of(long, False))
    for side in "ab":
        found = found.join(texts.select(F.col("id").alias(f"{side}_id"), F.col("word").alias(f"{side}_word")), f"{side}_id")
    found = found.filter((F.greatest(F.char_length("a_word"), F.char_length("b_word")) > LONG) & one).distinct()
    return short.unionByName(found)


def forms(pairs: DataFrame, ratio: int) -> DataFrame:
    """id, n_near, form (n, word and id of the most frequent near word, if frequent enough; ties: the first word)."""
    both = pairs.select(F.explode(F.array(*[F.struct(*[F.col(f"{x}_{c}").alias(c) for c in ("id", "n", "word")], *[F.col(f"{y}_{c}").alias(f"o_{c}") for c in ("id", "n", "word")]) for x, y in ("ab", "ba")])).alias("p"))
    form = F.struct((-F.col("p.o_n")).alias("minus"), F.col("p.o_word").alias("word"), F.col("p.o_id").alias("id"))
    one = both.select(F.col("p.id").alias("id"), F.when(F.col("p.o_n") >= ratio * F.col("p.n"), form).alias("form"))
    return one.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min("form").alias("form"))


def roots(steps: DataFrame) -> DataFrame:
    """steps (id, to, word): each word's form and its text -> the same with the last form that following them leads to.

    Forms are ever more frequent, so there are no rings. Every round doubles the steps taken; a chain has at most as many
    steps as the largest count has bits.
    """
    while True:
        ahead = steps.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("word").alias("next_word"))
        steps = settle(steps.join(ahead, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.coalesce("next_word", "word").alias("word"), F.col("next").isNotNull().alias("moved")))
        if not steps.filter("moved").head(1):
            return steps.drop("moved")
        steps = steps.drop("moved")


def grouped(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """counts (word, n; words unique and not null) -> word, form, root, n, n_near, form_n, one row a word.

    form is the near word with the largest n, if that is at least ``ratio`` times the word's, else null; of equals the
    first in code-point order. root is where the forms lead; the word itself if it has none. Words of any length are
    compared whole. An empty table gives an empty result.
    """
    words = stored(counts.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    found = stored(forms(near_pairs(words), ratio), "forms")
    ends = roots(settle(found.filter("form IS NOT NULL").select("id", F.col("form.id").alias("to"), F.col("form.word").alias("word"))))
    out = words.join(found, "id", "left").join(ends.select("id", F.col("word").alias("root")), "id", "left")
    return out.select("word", F.col("form.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("form.minus")).alias("form_n"))


def report(docs: DataFrame, spec: Spec = Spec(misspell=97)) -> DataFrame:
    return grouped(word_counts(docs, spec), spec.ratio)
