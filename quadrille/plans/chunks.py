"""Chunk sizes of the (time, band, y, x) stack."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

import numpy as np

DIMS = ("time", "band", "y", "x")
#: Bytes of an "auto" chunk.
AUTO = 128 << 20
UNITS = {"": 1, "B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "KIB": 1 << 10, "MIB": 1 << 20, "GIB": 1 << 30}


def bytes_of(text: str) -> int:
    m = re.fullmatch(r"\s*([\d.]+)\s*([A-Za-z]*)\s*", text)
    if not m or m[2].upper() not in UNITS:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * UNITS[m[2].upper()])


def normalize(chunks, shape: tuple[int, int, int, int], dtype="float64") -> tuple[tuple[int, ...], ...]:
    """Sizes along each dimension. One number or a pair is for y and x; time and band then go one by one.

    A dimension takes a size, a tuple of sizes, -1 or None for all of it, or "auto" or a byte size, which widens x and y
    before band and time.
    """
    if isinstance(chunks, bool):
        raise ValueError("chunks can't be a bool")
    if isinstance(chunks, int) and chunks != -1:
        chunks = (1, 1, chunks, chunks)
    elif isinstance(chunks, tuple) and len(chunks) == 2:
        chunks = (1, 1, *chunks)
    elif isinstance(chunks, Mapping):
        named = {DIMS.index(k) if isinstance(k, str) else k: v for k, v in chunks.items()}
        chunks = tuple(named.get(i, -1) for i in range(4))
    elif not isinstance(chunks, tuple | list):
        chunks = (chunks,) * 4
    if len(chunks) != 4:
        raise ValueError(f"chunks need 1, 2 or 4 entries, not {len(chunks)}")
    limits = [bytes_of(c) for c in chunks if isinstance(c, str) and c != "auto"]
    sizes: list = [None] * 4
    for i, (c, n) in enumerate(zip(chunks, shape, strict=True)):
        if isinstance(c, tuple | list):
            if sum(c) != n:
                raise ValueError(f"chunks {c} of dimension {DIMS[i]} don't add up to {n}")
            sizes[i] = tuple(c)
        elif not isinstance(c, str):
            size = n if c in (-1, None) else int(c)
            if size < 1 and n:
                raise ValueError(f"chunk sizes must be positive: {c}")
            sizes[i] = size
    room = min(limits, default=AUTO) // np.dtype(dtype).itemsize
    for s in sizes:
        if s is not None:
            room //= max(1, max(s) if isinstance(s, tuple) else min(s, AUTO))
    free = [i for i in (2, 3) if sizes[i] is None]
    if free:
        side = max(1, int(room ** (1 / len(free))))
        for i in sorted(free, key=lambda i: shape[i]):
            sizes[i] = max(1, min(shape[i], side))
            room //= sizes[i]
            side = max(1, room)
    for i in (1, 0):
        if sizes[i] is None:
            sizes[i] = max(1, min(shape[i], room))
            room //= sizes[i]
    return tuple(s if isinstance(s, tuple) else cut(n, s) for s, n in zip(sizes, shape, strict=True))


def cut(n: int, size: int) -> tuple[int, ...]:
    if n == 0:
        return (0,)
    return tuple(min(size, n - i * size) for i in range(math.ceil(n / size)))
