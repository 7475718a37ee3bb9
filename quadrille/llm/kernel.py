"""Words and shingles of whole Arrow columns of text, in NumPy over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in groups of about so many bytes, so that memory doesn't follow the batch size.
CHUNK = 1 << 19
U = np.uint64
M1, M2, BASE = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
BYTES = np.arange(256, dtype=np.uint8)
LOWERED = np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, BYTES).astype(np.uint8)
#: [^\x20\x09-\x0D]
IS_WORD = ~((BYTES == 0x20) | ((BYTES >= 0x09) & (BYTES <= 0x0D)))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased
IS_ALNUM = (BYTES >= 0x80) | ((BYTES >= 48) & (BYTES <= 57)) | ((BYTES >= 97) & (BYTES <= 122)) | ((BYTES >= 65) & (BYTES <= 90))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    x = np.array(x, dtype=U)
    x ^= x >> U(30)
    x *= U(M1)
    x ^= x >> U(27)
    x *= U(M2)
    x ^= x >> U(31)
    return x


BYTE_VALUE = mix(BYTES.astype(U) + U(BASE)) | U(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, mod 2 ** 64, for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        inverse = pow(BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, b, U)]), dtype=U) for b in (BASE, inverse)]
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a group of texts: start and end byte, text, and the words' range of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray  # of each text and one more

    def hashes(self, most: int = 0) -> np.ndarray:
        """Of the words' bytes after A-Z are lower-cased; equal words have equal hashes wherever they stand.

        most: of the first bytes only, so many at most.
        """
        out = np.empty(len(self.start), U)
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + CHUNK, "right")))
            at, to = int(self.start[a]), int(self.end[b - 1])
            up, down = powers(to - at + 1)
            sums = np.zeros(to - at + 1, U)
            np.cumsum(BYTE_VALUE[LOWERED[self.data[at:to]]] * up[: to - at], out=sums[1:])
            s, e = self.start[a:b] - at, self.end[a:b] - at
            e = np.minimum(e, s + most) if most else e
            out[a:b] = mix((sums[e] - sums[s]) * down[s])
            a = b
        return out

    def word(self, i: int) -> bytes:
        return LOWERED[self.data[self.start[i] : self.end[i]]].tobytes()


def texts(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of texts: first row, row after the last, their bytes, and where each text begins and the last ends."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, len(column))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def split(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray = IS_WORD) -> Words:
    inside = is_word[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    inner = bounds[1:-1]
    before[inner[inner < len(data)]] = False
    after[inner[inner > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, bounds)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(data, start, end, text, first)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles: (text, hash), sorted by both. A text with fewer words has its whole sequence as one."""
    h = w.hashes()
    size = len(h)
    if not size:
        return np.empty(0, np.int64), np.empty(0, U)
    last = w.first[1:][w.text]  # the word after the text's last one
    at = np.arange(size)
    total = np.zeros(size, U)
    for j in range(n):
        part = np.zeros(size, U)
        part[: max(0, size - j)] = h[j:]
        total = mix(total) + np.where(at + j < last, part, U(0))
    whole = (at + n <= last) | (at == w.first[:-1][w.text])
    text, value = w.text[whole], mix(total[whole])
    cuts = np.flatnonzero(np.r_[True, text[1:] != text[:-1], True])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        value[a:b].sort()
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def set_keys(text: np.ndarray, value: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the texts' sets, and a 64-bit key that is equal for equal sets."""
    sizes = np.bincount(text, minlength=n_texts).astype(np.int64)
    sums = np.zeros(n_texts, U)
    if len(value):
        starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        sums[text[starts]] = np.add.reduceat(mix(value + U(BASE)), starts)
    return sizes, mix(sums + sizes.astype(U) * U(M2))
