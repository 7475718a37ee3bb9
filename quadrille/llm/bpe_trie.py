"""Byte-pair encoding of a corpus through tries of its distinct words, and decoding.

How a word is encoded follows from its prefixes: the encoding of a prefix is that of a shorter one and one more token, and
exactly one token at its end gets along with the last token before it. So each trie node needs one state, its last token
and the node before that token. The states of the nodes above a node are enough to find its own, and words that begin
alike share them.

Two tokens get along if no merge joins a part of the one with a part of the other while they are put together. Along the
right edge of the first and the left edge of the second, from symbols up, what stands at the border at a time is known,
and whether the pair at the border would have been merged before either was merged into its own token.

Texts are encoded in the task that reads them: its distinct words go into a trie, and their encodings are put together
for each text. Nothing is shuffled or broadcast but the vocabulary's path. Tries and remembered words are dropped when
they are large.
"""

from __future__ import annotations

import array
import contextlib
import functools
import gc
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import ship, trimmed
from .token_records import ASCII_PARTS, WORDWISE, vocabulary_path

#: A worker's trie is dropped when it has more nodes; encoded words are kept in two generations of at most so many bytes.
NODES = 200_000
WORD_BYTES = 12 << 20
#: Bytes of texts that are handled at a time, and ids.
TEXTS = 1 << 20
IDS = 1 << 18
NEVER = 1 << 62
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The alphabet of byte-level vocabularies: a printable code point for each byte, the others in turn from 256 on.
PRINTABLE = {b: b for b in PLAIN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PLAIN)}


class Merges:
    """The tables of a vocabulary file: symbols, and of each merged token its rank and its two parts."""

    def __init__(self, model: dict):
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "fuse_unk", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise NotImplementedError(f"a {model['type']} vocabulary with {odd} can't be encoded by a trie")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, token = self.ids[a], self.ids[b], self.ids[a + b]
            if token in self.rank or max(self.rank.get(left, -1), self.rank.get(right, -1)) > rank:
                raise NotImplementedError(f"the token {a + b!r} is merged in two ways, or before its parts")
            self.merged[left, right], self.rank[token], self.parts[token] = token, rank, (left, right)
        self.spelled: dict[int, list[int]] = {}  # by token, its symbols
        atoms = {t: i for t, i in self.ids.items() if i not in self.rank and len(t.removesuffix(self.suffix) if self.suffix else t) == 1}
        for i in atoms.values():
            self.spelled[i] = [i]
        for token, (left, right) in self.parts.items():
            if left in self.spelled and right in self.spelled and self.meet(left, right) == (left, right):
                self.spelled[token] = self.spelled[left] + self.spelled[right]

    def meet(self, left: int, right: int) -> tuple[int, int] | None:
        """The first pair that is merged across the border of two tokens, each of which is put together from its symbols."""
        a, b = [left], [right]
        while a[-1] in self.parts:
            a.append(self.parts[a[-1]][1])
        while b[-1] in self.parts:
            b.append(self.parts[b[-1]][0])
        x, y = a.pop(), b.pop()
        while True:
            up_a, up_b = self.rank[a[-1]] if a else NEVER, self.rank[b[-1]] if b else NEVER
            joint = self.merged.get((x, y))
            # of equal pairs the one further left is merged first
            if joint is not None and self.rank[joint] < up_a and self.rank[joint] <= up_b:
                return x, y
            if not a and not b:
                return None
            if up_a <= up_b:
                x = a.pop()
            else:
                y = b.pop()

    def symbols(self, piece: str) -> list[int]:
        """What the vocabulary has no symbol for is left out."""
        ids = self.ids
        names = [*piece[:-1], piece[-1] + self.suffix] if piece else []
        return [i for i in map(ids.get, names) if i is not None]


class Trie:
    """Distinct words as paths of symbols. Node 0 is the empty word; every other node gets its last token and what precedes it."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.width = max(merges.ids.values()) + 1
        #: Tokens by their symbols from the last to the first: (state, symbol) -> state, and the token that a state spells.
        self.back: dict[int, int] = {}
        self.token_of: dict[int, int] = {}
        states = 0
        for token, symbols in merges.spelled.items():
            at = 0
            for s in reversed(symbols):
                to = self.back.get(at * self.width + s)
                if to is None:
                    states += 1
                    to = self.back[at * self.width + s] = states
                at = to
            self.token_of[at] = token
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.parent, self.symbol, self.last, self.before = [0], [-1], [-1], [0]
        self.fresh: dict[int, list[int]] = {}
        self.along: dict[int, bool] = {}

    def insert(self, symbols: list[int]) -> int:
        """The node of a word."""
        at, child, width = 0, self.child, self.width
        for s in symbols:
            to = child.get(at * width + s)
            if to is None:
                to = child[at * width + s] = len(self.parent)
                self.parent.append(at)
                self.symbol.append(s)
                self.last.append(-1)
                self.before.append(0)
                self.fresh.setdefault(at, []).append(to)
            at = to
        return at

    def gets_along(self, left: int, right: int) -> bool:
        key = left * self.width + right
        found = self.along.get(key)
        if found is None:
            found = self.along[key] = self.merges.meet(left, right) is None
        return found

    def settle(self) -> None:
        """Depth first from the nodes that were there before, each new node's state from those above it."""
        last, before, parent, symbol = self.last, self.before, self.parent, self.symbol
        back, token_of, width = self.back, self.token_of, self.width
        fresh, self.fresh = self.fresh, {}
        todo = [to for at, new in fresh.items() if at == 0 or last[at] >= 0 for to in new]
        while todo:
            node = todo.pop()
            state, at = 0, node
            while True:
                state = back[state * width + symbol[at]]
                at = parent[at]
                token = token_of.get(state)
                if token is not None and (at == 0 or self.gets_along(last[at], token)):
                    break
            last[node], before[node] = token, at
            todo.extend(fresh.get(node, ()))

    def tokens(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(self.last[node])
            node = self.before[node]
        return out[::-1]


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """Without garbage collection, for work that makes many objects and no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Codec:
    """A vocabulary in a worker: how it cuts texts into words, the trie, and the words that were encoded lately."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        self.path, self.model = path, steps["model"]
        self.added = {t["content"]: t["id"] for t in steps["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in steps["added_tokens"]):
            raise NotImplementedError("added tokens that take white space or are normalised")
        if steps["post_processor"] and steps["post_processor"]["type"] != "ByteLevel":
            raise NotImplementedError(f"the post-processor {steps['post_processor']['type']}")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        #: Whether white space ends words before anything else does, so that each word is cut on its own.
        self.wordwise = all(steps[k] == v for k, v in WORDWISE.items()) and not any(re.search(r"\s", t) for t in self.added)
        self.decoder = (steps["decoder"] or {}).get("type")
        if self.decoder not in (None, "ByteLevel"):
            raise NotImplementedError(f"the decoder {self.decoder}")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.known_bytes = 0

    @functools.cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @functools.cached_property
    def merges(self) -> Merges:
        return Merges(self.model)

    @functools.cached_property
    def trie(self) -> Trie:
        return Trie(self.merges)

    def pieces(self, text: str) -> list[str]:
        t = self.tokenizer
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        return [p for p, _ in t.pre_tokenizer.pre_tokenize_str(text)] if t.pre_tokenizer else [text]

    def cut_up(self, word: bytes) -> list[str | int]:
        """Pieces that are merged each on its own, and the numbers of added tokens."""
        if self.wordwise and word.isascii() and b"<|" not in word:
            word = word.lower()
            return [word.decode()] if word.isalpha() else [p.decode().translate(PRINTABLE) for p in ASCII_PARTS.findall(word)]
        out: list[str | int] = []
        text = word.decode()
        for part in self.cut.split(text) if self.cut else [text]:
            out.extend([self.added[part]] if part in self.added else self.pieces(part) if part else [])
        return out

    def learn(self, words: Iterable[bytes]) -> None:
        """Encodes distinct words: all go into the trie before its new nodes get their states."""
        ends: list[tuple[bytes, list[int]]] = []
        nodes: dict[str, int] = {}
        for word in words:
            path = []
            for p in self.cut_up(word):
                if isinstance(p, int):
                    path.append(-p - 1)
                    continue
                if p not in nodes:
                    nodes[p] = self.trie.insert(self.merges.symbols(p))
                path.append(nodes[p])
            ends.append((word, path))
        self.trie.settle()
        tokens = {node: self.trie.tokens(node) for node in nodes.values()}
        for word, path in ends:
            ids = [i for n in path for i in (tokens[n] if n >= 0 else [-n - 1])]
            self.remember(word, array.array("i", ids).tobytes())

    def remember(self, word: bytes, ids: bytes) -> None:
        self.known[word] = ids
        self.known_bytes += len(word) + len(ids)

    @uncollected()
    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids of all."""
        if len(self.trie.parent) > NODES:
            self.trie.clear()
        if self.known_bytes > WORD_BYTES:
            self.known, self.older, self.known_bytes = {}, self.known, 0
        cut: list[list[bytes]] = [((t.lower() if t.isascii() and b"<|" not in t else t).split() if self.wordwise else [t] if t else []) for t in texts]
        new = set().union(*cut).difference(self.known)
        for word in new.intersection(self.older):
            self.remember(word, self.older[word])
        self.learn(new.difference(self.known))
        known = self.known.__getitem__
        ids = [b"".join(map(known, words)) for words in cut]
        return np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids)), np.frombuffer(b"".join(ids), "<i4")

    def names(self) -> pa.Array:
        """The vocabulary's strings by id; null where there is none."""
        every = self.model["vocab"] | self.added
        out: list[str | None] = [None] * (1 + max(every.values()))
        for t, i in every.items():
            out[i] = t
        return pa.array(out, pa.string())

    def spellings(self) -> list[bytes]:
        """For a byte-level decoder: the bytes of each token."""
        byte = {chr(c): b for b, c in PRINTABLE.items()}
        return [b"" if t is None else bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in self.names().to_pylist()]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each worker process, which tasks share."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the token numbers of every whole text, without special tokens around it.

    Null and empty texts have none. Long texts are encoded whole; words of any length take one node a symbol. Equal texts
    have equal ids, repeated rows and null identifiers are rows of their own. Other columns, whatever their names, are not
    read. An empty table gives an empty result.
    """
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            for a, b, data, bounds in kernel.texts(batch.column(1), TEXTS):
                raw, at = data.tobytes(), bounds.tolist()
                sizes, ids = c.encode([raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(trimmed(run), f"`{id_col}` {kind}, ids array<int>")


def spell(c: Codec) -> Callable[[pa.Array], pa.Array]:
    """A function from lists of ids to texts: tokens' names with a space between, or the text that their bytes spell."""
    if c.decoder is None:
        names = c.names()

        def joined(ids: pa.Array) -> pa.Array:
            return pc.binary_join(pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), names.take(ids.flatten())), " ")

        return joined
    parts = c.spellings()
    return lambda ids: pa.array([b"".join(map(parts.__getitem__, x or [])).decode("utf-8", "replace") for x in ids.to_pylist()], pa.string())


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """All columns and ``decoded``: the text that the ids stand for, with special tokens. Null and no ids give an empty text."""
    ship(encoded.sparkSession)
    place = encoded.columns.index(ids_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_text = spell(codec(vocabulary))
        for batch in batches:
            ids = batch.column(place)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + IDS, "right")))
                part = batch.slice(a, b - a)
                lists = pa.array([[]], part.column(place).type).take(pa.array([0] * len(part))) if part.column(place).null_count == len(part) else pc.if_else(pc.is_valid(part.column(place)), part.column(place), pa.scalar([], part.column(place).type)) if part.column(place).null_count else part.column(place)
                yield pa.RecordBatch.from_arrays([*part.columns, to_text(lists)], [*part.schema.names, "decoded"])
                a = b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(trimmed(run), f"{schema}, decoded string")


def report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text that they decode to."""
    vocabulary = vocabulary or vocabulary_path()
    out = decode(encode(docs, vocabulary), vocabulary)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
