"""SentencePiece encoding and decoding on a relational lattice of the corpus's distinct words.

A word is a maximal run of characters that no piece boundary rule separates: between two characters that stand next to
each other in no piece, no piece can cross, so a text's pieces are the pieces of its words, one after the other. The
corpus is reduced to distinct words with counts. Their substrings of up to the longest piece's length are exploded and
equi-joined to the piece table (a vocabulary, so it may be broadcast); matches are the edges of the word's lattice, and
a fold with Spark's aggregate() over the edges, grouped by word, gives the best segmentation: for unigram models the
path with the highest sum of scores (Viterbi), for BPE models the path that merging the best-scored neighbours, again
and again, ends with. Characters without a piece become byte pieces.

Words of more than MAX_WORD characters (rulers, filler, text without spaces) are few and too long for the lattice's place
fields; they stay whole and are encoded where they stand, by the same merges on a priority queue or the same Viterbi.

Texts are then put together from the words' ids: the HEAD most frequent words come as a broadcast of bounded size, and
each text's other words by a join on the word's hash, so the vocabulary may grow without bound.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import ship, stored, trim, trimmed

SPACE = "▁"
#: Words in the broadcast table, about 24 bytes each.
HEAD = 1_500_000
#: Longer words are encoded by Vocabulary.pieces_of(); places of the lattice have 8 bits.
MAX_WORD = 128
#: Characters of long words whose ids a task remembers.
KEPT = 1 << 21
#: Characters by which the lengths of a place's substrings are looked up.
HEADS = 3
#: Words whose cuts fit into the bits of one number.
SHORT = 62
#: Words that a map task holds before it sends their counts.
HELD = 300_000
#: Parts into which the copies of a text are dealt out.
SALTS = 16
U = np.uint64
CHAR_VALUE = kernel.mix(np.arange(1 << 16).astype(U) + U(kernel.BASE)) | U(1)


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    bytes_: list[int]  # piece number of every byte
    plain: list[bool]  # pieces that stand for their text
    kind: str  # bpe or unigram

    def __post_init__(self):
        multi = [p for p, ok in zip(self.pieces, self.plain, strict=True) if ok and len(p) > 1]
        self.longest = max(map(len, multi), default=1)
        chars = sorted({c for p in multi for c in p})
        number = {c: i + 1 for i, c in enumerate(chars)}
        self.number = np.zeros(max(map(ord, chars), default=0) + 2, np.int32)  # of a character; 0 for those of no longer piece
        self.number[[ord(c) for c in chars]] = range(1, len(chars) + 1)
        self.across = np.zeros((len(chars) + 1) ** 2, bool)  # whether two characters stand next to each other in a piece
        for p in multi:
            for a, b in itertools.pairwise(p):
                self.across[number[a] * (len(chars) + 1) + number[b]] = True
        self.side = len(chars) + 1
        text = [b"" for _ in self.pieces]
        for i, (p, ok) in enumerate(zip(self.pieces, self.plain, strict=True)):
            text[i] = p.replace(SPACE, " ").encode() if ok else b""
        for b, i in enumerate(self.bytes_):
            text[i] = bytes([b])
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.first = np.r_[0, np.cumsum([len(t) for t in text])]

    @classmethod
    def load(cls, path: str, kind: str = "bpe") -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(len(m))
        return cls([m.id_to_piece(i) for i in n], [m.get_score(i) for i in n], [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in n], kind)

    def words(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """The normalised texts end to end; begin of each word and of the end; hash of each; first word of each text."""
        norm = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        flat = "".join(norm)
        code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.r_[0, np.cumsum([len(t) for t in norm])]
        cls = self.number[np.minimum(code, len(self.number) - 1)]
        cut = np.ones(len(code) + 1, bool)
        cut[1:-1] = ~self.across[cls[:-1] * self.side + cls[1:]]
        cut[bounds] = True
        begin = np.flatnonzero(cut)
        value = CHAR_VALUE[np.minimum(code, 0xFFFF)]
        wide = code > 0xFFFF
        if wide.any():
            value[wide] = kernel.mix(code[wide].astype(U) + U(kernel.BASE)) | U(1)
        hashes = np.empty(len(begin) - 1, U)
        step = kernel.CHUNK  # the powers' table stays bounded
        i = 0
        while i < len(hashes):
            j = max(i + 1, int(np.searchsorted(begin, begin[i] + step, "right")) - 1)
            a, b = int(begin[i]), int(begin[j])
            if b - a > step:  # one word
                hashes[i] = int.from_bytes(hashlib.blake2b(flat[a:b].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                i = j
                continue
            up, down = kernel.powers(b - a + 1)
            sums = np.zeros(b - a + 1, U)
            np.cumsum(value[a:b] * up[: b - a], out=sums[1:])
            x = begin[i : j + 1] - a
            hashes[i:j] = kernel.mix((sums[x[1:]] - sums[x[:-1]]) * down[x[:-1]])
            i = j
        return flat, begin, hashes, np.searchsorted(begin, bounds)

    @functools.cached_property
    def lengths(self) -> dict[str, list[int]]:
        """Lengths below HEADS, and of the pieces that begin so, by the first HEADS characters of longer pieces."""
        found: dict[str, set[int]] = {}
        for p, ok in zip(self.pieces, self.plain, strict=True):
            if ok and len(p) >= HEADS:
                found.setdefault(p[:HEADS], set(range(1, HEADS))).add(len(p))
        return {p: sorted(k) for p, k in found.items()}

    @functools.cached_property
    def ranks(self) -> dict[float, int]:
        """Rank of every score, best first."""
        return {x: i for i, x in enumerate(sorted({x for x, ok in zip(self.scores, self.plain, strict=True) if ok}, reverse=True))}

    @functools.cached_property
    def plain_pieces(self) -> dict[str, tuple[int, int]]:
        """Rank and number of every piece that stands for its text."""
        return {p: (self.ranks[x], i) for i, (p, x, ok) in enumerate(zip(self.pieces, self.scores, self.plain, strict=True)) if ok}

    def pieces_of(self, word: str) -> list[int]:
        """Ids of a word of any length: what the lattice's fold gives, in n log n steps (BPE) or n times the longest piece."""
        cuts = self.best(word) if self.kind == "unigram" else self.merged(word)
        out = []
        for a, b in itertools.pairwise(cuts):
            known = self.plain_pieces.get(word[a:b])
            out.extend([known[1]] if known else [self.bytes_[x] for x in word[a:b].encode()])
        return out

    def merged(self, word: str) -> list[int]:
        """Cuts that are left when the best-scored neighbours, of equal ones the first, are merged again and again."""
        n, table = len(word), self.plain_pieces
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))  # after: 0 where no symbol begins any more
        heap = [(found[0] << 40) | a for a in range(n - 1) if (found := table.get(word[a : a + 2]))]
        heapq.heapify(heap)
        while heap:
            x = heapq.heappop(heap)
            a = x & ((1 << 40) - 1)
            b = after[a]
            if not b or b == n:
                continue
            e = after[b]
            found = table.get(word[a:e])
            if not found or found[0] != x >> 40:
                continue
            after[a], after[b] = e, 0
            if e < n:
                before[e] = a
            for left in (before[a], a):
                if left >= 0 and after[left] < n and (found := table.get(word[left : after[after[left]]])):
                    heapq.heappush(heap, (found[0] << 40) | left)
        cuts = [0]
        while cuts[-1] < n:
            cuts.append(after[cuts[-1]])
        return cuts

    def best(self, word: str) -> list[int]:
        """Cuts of the path of least cost; of equal ones the last piece has the best score, then the first place."""
        table = self.plain_pieces
        worst = min((x for x, ok in zip(self.scores, self.plain, strict=True) if ok), default=0.0) - 10.0
        cost, back = array("d", [0.0]), array("q", [0])
        for e in range(1, len(word) + 1):
            ways = []
            for s in range(max(0, e - self.longest), e):
                if found := table.get(word[s:e]):
                    ways.append((cost[s] - self.scores[found[1]], found[0], s))
                elif s == e - 1:
                    ways.append((cost[s] - worst, len(self.ranks), s))
            least = min(ways)
            cost.append(least[0])
            back.append(least[2])
        cuts = [len(word)]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        return cuts[::-1]


def groups(batches: Iterable[pa.RecordBatch], at: int, most: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches of about ``most`` characters, with their texts."""
    for batch in batches:
        texts, a, size = [], 0, 0
        for i, t in enumerate(batch.column(at).to_pylist()):
            texts.append(t or "")
            size += len(texts[-1])
            if size >= most:
                yield batch.slice(a, i + 1 - a), texts
                texts, a, size = [], i + 1, 0
        if texts:
            yield batch.slice(a), texts


def corpus_words(docs: DataFrame, vocab) -> DataFrame:
    """h, word, n of every distinct word of at most MAX_WORD characters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        seen: dict[int, list] = {}

        def send() -> Iterator[pa.RecordBatch]:
            items = list(seen.items())
            seen.clear()
            for i in range(0, len(items), 50_000):
                part = items[i : i + 50_000]
                h = np.array([k for k, _ in part], U).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([x[0] for _, x in part], pa.string()), pa.array([x[1] for _, x in part], pa.int64())], ["h", "word", "n"])

        for _, texts in groups(batches, 0):
            flat, begin, hashes, _ = v.words(texts)
            short = np.flatnonzero(np.diff(begin) <= MAX_WORD)
            h, first, n = np.unique(hashes[short], return_index=True, return_counts=True)
            first = short[first]
            for k, a, b, c in zip(h.tolist(), begin[first].tolist(), begin[first + 1].tolist(), n.tolist(), strict=True):
                if k in seen:
                    seen[k][1] += c
                else:
                    seen[k] = [flat[a:b], c]
            if len(seen) > HELD:
                yield from send()
        yield from send()

    # a word's lattice is many times as large as its row: small partitions keep it in memory
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.mapInArrow(trimmed(run), "h long, word string, n long").repartition(parts, "h").groupBy("h", "word").agg(F.sum("n").alias("n"))


def lattice(words: DataFrame, v: Vocabulary) -> DataFrame:
    """h, n, size, edges and unknown of every word.

    An edge is one number: rank of its piece by score (best first), place s where it begins, place e behind it, and the
    piece; so edges are sorted by score, then place. unknown has (s, character) where no piece fits.
    """
    spark = words.sparkSession
    ranks = v.ranks
    plain = [(p, (ranks[x] << 40) | i) for i, (p, x, ok) in enumerate(zip(v.pieces, v.scores, v.plain, strict=True)) if ok]
    pieces = F.broadcast(spark.createDataFrame(plain, "piece string, packed long"))  # the model's vocabulary
    at = words.withColumn("size", F.char_length("word")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    # of the substrings that begin at a place, those of a length that some piece with the same first HEADS characters has
    heads = F.broadcast(spark.createDataFrame([(p, list(k)) for p, k in v.lengths.items()] or [("", [])], "head string, lengths array<int>"))
    at = at.withColumn("head", F.substring("word", F.col("s") + 1, F.lit(HEADS))).join(heads, "head", "left")
    short = F.array(*[F.lit(k) for k in range(1, HEADS)])
    at = at.withColumn("k", F.explode(F.coalesce("lengths", short))).filter("k <= size - s")
    at = at.select("h", "n", "size", "s", "k", F.substring("word", F.col("s") + 1, F.col("k")).alias("piece"))
    at = at.join(pieces, "piece", "left").filter("packed IS NOT NULL OR k = 1")
    known = F.col("packed").isNotNull()
    place = F.expr("shiftleft(CAST(s AS BIGINT), 32) | shiftleft(CAST(s + k AS BIGINT), 24)")
    edge = F.when(known, F.col("packed")).otherwise(F.lit((len(ranks) << 40) | UNKNOWN)).bitwiseOR(place)
    at = at.select("h", "n", "size", edge.alias("edge"), F.when(~known, F.struct("s", "piece")).alias("none"))
    return at.groupBy("h").agg(F.max("n").alias("n"), F.max("size").alias("size"), F.sort_array(F.collect_list("edge")).alias("edges"), F.collect_list("none").alias("unknown"))


UNKNOWN = (1 << 24) - 1
S, E, ID = "CAST(shiftright({x}, 32) & 255 AS INT)", "CAST(shiftright({x}, 24) & 255 AS INT)", f"CAST({{x}} & {UNKNOWN} AS INT)"
#: The cuts of a word are bits of a mask. An edge that is left has both ends cut, and can be made if one cut lies between;
#: what is asked of edges again and again is worked out once: the cuts inside (i), those at its ends (e), and itself (x).
INNER = f"(m.m & (shiftleft(1L, {E}) - shiftleft(1L, {S} + 1)))"
SEEN = INNER.format(x="x")
MULTI = f"""transform(filter(edges, x -> {E.format(x="x")} > {S.format(x="x")} + 1), x -> named_struct(
  'i', shiftleft(1L, {E.format(x="x")}) - shiftleft(1L, {S.format(x="x")} + 1), 'e', shiftleft(1L, {S.format(x="x")}) | shiftleft(1L, {E.format(x="x")}), 'x', x))"""
#: The best-scored such edge loses its inner cut; edges that end there are out, and so is the edge.
MERGES = """aggregate(sequence(1, size), named_struct('m', shiftleft(1L, size + 1) - 1, 'left', multi),
  (m, k) -> if(size(m.left) = 0, m, coalesce(get(transform(slice(filter(m.left, x -> bit_count(m.m & x.i) = 1), 1, 1), b -> named_struct('m', m.m ^ (m.m & b.i),
    'left', filter(m.left, y -> y.x <> b.x AND (y.e & m.m & b.i) = 0))), 0),
    named_struct('m', m.m, 'left', slice(m.left, 1, 0)))), m -> m.m)"""
SHORT_TAKEN = f"""filter(edges, x -> (shiftright(mask, {S.format(x="x")}) & shiftright(mask, {E.format(x="x")}) & 1L) = 1L AND {SEEN.replace("m.m", "mask")} = 0L)"""
#: The same with the cuts as an array.
BETWEEN = f"size(filter(c, y -> y > {S.format(x='x')} AND y < {E.format(x='x')}))"
ENDS = f"array_contains(c, {S.format(x='x')}) AND array_contains(c, {E.format(x='x')})"
LONG_CUTS = f"""aggregate(sequence(1, size), sequence(0, size), (c, i) -> coalesce(get(transform(slice(
  filter(edges, x -> {E.format(x="x")} > {S.format(x="x")} + 1 AND {ENDS} AND {BETWEEN} = 1), 1, 1),
  x -> filter(c, y -> y <= {S.format(x="x")} OR y >= {E.format(x="x")})), 0), c))"""
LONG_TAKEN = f"filter(edges, x -> {ENDS} AND {BETWEEN} = 0)"
#: Viterbi: for every place the least cost to get there, and the edge that ends the best way.
BEST = f"""aggregate(sequence(1, size), array(named_struct('cost', 0.0D, 'edge', 0L)), (b, i) ->
  concat(b, array(array_min(transform(filter(edges, x -> {E.format(x="x")} = i), x -> named_struct('cost', b[{S.format(x="x")}].cost + costs[{ID.format(x="x")}], 'edge', x))))))"""
BACK = f"""aggregate(sequence(1, size), named_struct('at', size, 'taken', cast(array() AS array<bigint>)), (t, i) ->
  if(t.at = 0, t, named_struct('at', {S.format(x="best[t.at].edge")}, 'taken', concat(array(best[t.at].edge), t.taken))), t -> t.taken)"""


def segmented(edges: DataFrame, v: Vocabulary) -> DataFrame:
    """h, n, ids: the pieces that the fold takes, in order; unknown characters are spelled in byte pieces."""
    if v.kind == "unigram":
        worst = min((x for x, ok in zip(v.scores, v.plain, strict=True) if ok), default=0.0) - 10.0
        costs = F.lit([-x for x in v.scores])
        text = BEST.replace(f"costs[{ID.format(x='x')}]", f"if({ID.format(x='x')} = {UNKNOWN}, {-worst!r}D, costs[{ID.format(x='x')}])")
        d = edges.withColumn("costs", costs).withColumn("best", F.expr(text)).withColumn("taken", F.expr(BACK))
    else:
        short = F.col("size") <= SHORT
        d = edges.withColumn("multi", F.when(short, F.expr(MULTI)))
        d = d.withColumn("mask", F.when(short, F.expr(MERGES))).withColumn("c", F.when(~short, F.expr(LONG_CUTS)))
        d = d.withColumn("taken", F.when(short, F.expr(SHORT_TAKEN)).otherwise(F.expr(LONG_TAKEN)))
    d = d.withColumn("taken", F.expr(f"sort_array(transform(taken, x -> x & {(1 << 40) - 1}))"))  # by place
    plain = F.expr(f"transform(taken, x -> {ID.format(x='x')})")
    bytes_ = F.array(*[F.lit(i) for i in v.bytes_])

    def spelled(x: Column) -> Column:
        at = F.shiftright(x, 32).cast("int")
        raw = F.hex(F.encode(F.get(F.filter("unknown", lambda u: u["s"] == at), 0)["piece"], "UTF-8"))
        ids = F.transform(F.sequence(F.lit(1), F.length(raw) - 1, F.lit(2)), lambda i: F.element_at(bytes_, F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("int") + 1))
        return F.when(x.bitwiseAND(UNKNOWN) == UNKNOWN, ids).otherwise(F.array(x.bitwiseAND(UNKNOWN).cast("int")))

    return d.select("h", "n", F.when(F.size("unknown") == 0, plain).otherwise(F.flatten(F.transform("taken", spelled))).alias("ids"))


@dataclass
class Table:
    """Ids of words by sorted hash."""

    h: np.ndarray
    first: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, h: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> Table:
        order = np.argsort(h)
        first = np.r_[0, np.cumsum(lengths)]
        return cls(h[order], np.r_[0, np.cumsum(lengths[order])], ids[ranges(first[:-1][order], lengths[order])])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of every hash, or -1."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)


def ranges(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + lengths[0] - 1, first[1] .., end to end."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - total + lengths, lengths)


def head_of(words: DataFrame, most: int) -> tuple[Table, int]:
    """The most frequent words, at most ``most``, and the count that they have at least."""
    counts = sorted((-r["c"], r["k"]) for r in words.groupBy(F.least("n", F.lit(60_000)).alias("c")).agg(F.count(F.lit(1)).alias("k")).collect())
    cutoff, total = 1 << 60, 0
    for c, k in counts:
        if total + k > most:
            break
        cutoff, total = -c, total + k
    got = words.filter(F.col("n") >= cutoff).select("h", "ids").toArrow()
    ids = got["ids"].combine_chunks()
    lengths = np.asarray(pa.compute.list_value_length(ids), np.int64)
    return Table.of(np.asarray(got["h"], np.int64).view(U), lengths, np.asarray(ids.flatten(), np.int32)), cutoff


def rare_words(docs: DataFrame, vocab, head) -> DataFrame:
    """(key, h) of the words that the head lacks, long ones apart, once for a key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups(batches, 1):
            _, begin, hashes, first = vocab.value.words(texts)
            text = np.repeat(np.arange(len(texts)), np.diff(first))
            distinct, back = np.unique(hashes, return_inverse=True)
            miss = (head.value.find(distinct) < 0)[back] & (np.diff(begin) <= MAX_WORD)
            pair = np.unique(np.stack([text[miss].astype(U), hashes[miss]]), axis=1) if miss.any() else np.empty((2, 0), U)
            key = np.asarray(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(key[pair[0].astype(np.int64)]), pa.array(pair[1].view(np.int64))], ["key", "h"])

    return docs.mapInArrow(trimmed(run), "key long, h long").distinct()


def packed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text) -> (key, doc_id, text compressed): texts travel to their rare words, not the other way."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            text = pa.array([c.compress(t.as_buffer()) if t.is_valid else None for t in batch.column(2).cast(pa.binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], ["key", "doc_id", "text"])

    return docs.mapInArrow(trimmed(run), "key long, doc_id long, text binary")


def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = zstandard.ZstdDecompressor()
    for batch in batches:
        text = pa.array([d.decompress(t.as_buffer()) if t.is_valid else None for t in batch.column(1)], pa.binary())
        yield batch.set_column(1, "text", text.cast(pa.string()))


def encode(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text", head_size: int = HEAD) -> DataFrame:
    """One row per input row: doc_id, ids, n_pieces, ids_crc32 (of the ids as unsigned 32-bit numbers), round_trip.

    round_trip tells whether the decoded ids are the text (they are unless it holds U+2581, which stands for a space).
    Null and empty texts have no pieces. Repeated rows are encoded each. Copies of a text meet their rare words in SALTS
    tasks, by their identifiers. Long texts, and long runs in them, are encoded whole. Other columns, whatever their
    names, are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    vocab = spark.sparkContext.broadcast(v)
    text = F.col(text_col)
    words = stored(segmented(lattice(corpus_words(docs.select(text.alias("text")), vocab), v), v), "words")
    table, cutoff = head_of(words, head_size)
    head = spark.sparkContext.broadcast(table)
    del table  # the driver needs it no more
    trim()
    salt = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(SALTS))  # copies of a text are dealt out, each part with its rare words
    keyed = docs.select(F.xxhash64(text, salt).alias("key"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rare = rare_words(keyed.select("key", "text"), vocab, head).join(words.filter(F.col("n") < cutoff).select("h", "ids"), "h")
    rare = rare.groupBy("key").agg(F.collect_list(F.struct("h", "ids")).alias("rare"))  # bounded by the text's words
    both = packed(keyed).join(rare, "key", "left").select("doc_id", "text", "rare")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = vocab.value, head.value
        kept, held = {}, 0  # ids of long words
        for batch, texts in groups(unpacked(batches), 1):
            flat, begin, hashes, first = v.words(texts)
            distinct, back = np.unique(hashes, return_inverse=True)
            if held > KEPT:
                kept, held = {}, 0
            long = {}
            for i in np.flatnonzero(np.diff(begin) > MAX_WORD).tolist():
                h = int(hashes[i])
                if h not in kept:
                    kept[h] = np.array(v.pieces_of(flat[begin[i] : begin[i + 1]]), np.int32)
                    held += int(begin[i + 1] - begin[i])
                long[h] = kept[h]
            at = known.find(distinct)
            lists = batch.column(2).flatten()
            own_h, own = (np.asarray(lists.field(0), np.int64).view(U), lists.field(1)) if len(lists) else (np.empty(0, U), None)
            own_h, one = np.unique(own_h, return_index=True)
            own = own.take(pa.array(one)) if own is not None else pa.array([], pa.list_(pa.int32()))
            lengths = np.r_[np.asarray(pa.compute.list_value_length(own), np.int64), np.array([len(x) for x in long.values()], np.int64)]
            extra = Table.of(np.r_[own_h, np.array(list(long), U)], lengths, np.concatenate([np.asarray(own.flatten(), np.int32), *long.values()]))
            miss = at < 0
            other = extra.find(distinct[miss])
            if (other < 0).any():
                raise ValueError("a word of the corpus has no entry")
            # a table of this group's words, from both
            n, begin = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
            n[~miss] = known.first[at[~miss] + 1] - known.first[at[~miss]]
            n[miss] = extra.first[other + 1] - extra.first[other]
            begin[~miss], begin[miss] = known.first[at[~miss]], extra.first[other]
            own_ids, from_extra = np.empty(int(n.sum()), np.int32), np.repeat(miss, n)
            own_ids[~from_extra] = known.ids[ranges(begin[~miss], n[~miss])]
            own_ids[from_extra] = extra.ids[ranges(begin[miss], n[miss])]
            lengths = n[back]
            ids = own_ids[ranges((np.cumsum(n) - n)[back], lengths)]
            cuts = np.r_[0, np.cumsum(lengths)][first]
            sizes = v.first[ids + 1] - v.first[ids]
            decoded = v.text[ranges(v.first[ids], sizes)].tobytes()
            ends = np.r_[0, np.cumsum(sizes)][cuts].tolist()
            whole = [decoded[a + 1 : b] == t.encode() for a, b, t in zip(ends[:-1], ends[1:], texts, strict=True)]
            little = ids.astype("<u4")
            crc = [zlib.crc32(little[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            out = [batch.column(0), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids)), pa.array(np.diff(cuts)), pa.array(crc, pa.int64()), pa.array(whole)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "n_pieces", "ids_crc32", "round_trip"])

    return both.mapInArrow(trimmed(run), "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, round_trip boolean")


def decode(encoded: DataFrame, v: Vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of the ids, and replaces a column that has this name already.

    Bytes that are no UTF-8 become U+FFFD; null ids give null and no ids an empty text. Rows are decoded each; an empty
    table gives an empty result. The name of the new column is a parameter.
    """
    ship(encoded.sparkSession)
    vocab = encoded.sparkSession.sparkContext.broadcast(v)

    @F.pandas_udf("string")
    def text_of(ids):
        v = vocab.value

        def one(x):
            if x is None:
                return None
            x = np.asarray(x, np.int64)
            t = v.text[ranges(v.first[x], v.first[x + 1] - v.first[x])].tobytes()
            return t[1 if t[:1] == b" " else 0 :].decode("utf-8", "replace")

        return ids.map(one)

    return encoded.withColumn(out_col, text_of(F.col(ids_col)))


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    return encode(docs, Vocabulary.load(path or model_path()))
