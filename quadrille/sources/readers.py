"""Readers of single-band rasters: NumPy files, a subset of GeoTIFF, constants. A dataset gives masked windows, read by ranges."""

from __future__ import annotations

import functools
import io
import struct
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np


class Dataset(Protocol):
    """An open raster. Unknown epsg and transform are None."""

    epsg: int | None
    transform: tuple | None

    @property
    def shape(self) -> tuple[int, int]: ...

    def at(self, step: float) -> Dataset:
        """The coarsest level of it that is no coarser than ``step`` of its pixels; asked for if it has ``levels``."""
        ...

    def block(self, y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
        """float64, with NaN where the file has nodata or no opacity."""
        ...


@dataclass
class Raster:
    """Decoded pixels with what the file says about them; what is unknown is None."""

    data: np.ndarray
    epsg: int | None = None
    transform: tuple | None = None
    nodata: float | None = None
    alpha: np.ndarray | None = None

    @property
    def shape(self) -> tuple[int, int]:
        return self.data.shape

    @functools.cached_property
    def values(self) -> np.ndarray:
        """As float64 with NaN where the file has nodata or no opacity."""
        out = self.data.astype("float64")
        if self.nodata is not None:
            out[self.data == self.nodata] = np.nan
        if self.alpha is not None:
            out[self.alpha == 0] = np.nan
        return out

    def at(self, step: float) -> Raster:
        return self

    def block(self, y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
        cut = np.s_[y0:y1, x0:x1]
        return Raster(self.data[cut], nodata=self.nodata, alpha=None if self.alpha is None else self.alpha[cut]).values


class Reader(Protocol):
    """Anything that can be pickled and opens a url: ``reader(url, options) -> Dataset``."""

    def __call__(self, url: str, options: dict) -> Dataset: ...


class Ranges:
    """A file that is read by ranges. Its beginning, where headers stand, is read at once; close ranges are read as one."""

    HEAD, GAP = 1 << 14, 1 << 13

    def __init__(self, url: str):
        import pyarrow.fs as pafs

        fs, path = pafs.FileSystem.from_uri(url if "://" in url else f"file://{url}")
        self.file = fs.open_input_file(path)
        self.bytes_read, self.head = 0, b""
        self.head = self.get(0, min(self.HEAD, self.file.size()))

    def get(self, begin: int, n: int) -> bytes:
        if begin + n <= len(self.head):
            return self.head[begin : begin + n]
        self.bytes_read += n
        return self.file.read_at(n, begin)

    def many(self, spans: Sequence[tuple[int, int]]) -> list[bytes]:
        """The contents of (begin, length) spans."""
        out: list[bytes] = [b""] * len(spans)
        todo = sorted((b, n, i) for i, (b, n) in enumerate(spans) if n)
        while todo:
            end, k = todo[0][0] + todo[0][1], 1
            while k < len(todo) and todo[k][0] <= end + self.GAP:
                end = max(end, todo[k][0] + todo[k][1])
                k += 1
            start = todo[0][0]
            data = self.get(start, end - start)
            for b, n, i in todo[:k]:
                out[i] = data[b - start : b - start + n]
            todo = todo[k:]
        return out


class Npy:
    """A .npy file in C order, by rows."""

    epsg, transform = None, None

    def __init__(self, url: str, nodata: float | None = None):
        self.src, self.nodata = Ranges(url), nodata
        f = io.BytesIO(self.src.head)
        version = np.lib.format.read_magic(f)
        shape, fortran, self.dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if len(shape) != 2:
            raise RuntimeError(f"{url!r} must be a single band, but has the shape {shape}")
        if self.dtype.hasobject:
            raise RuntimeError(f"{url!r} holds objects")
        self.shape, self.begin, self.turned = shape, f.tell(), fortran

    def at(self, step: float) -> Npy:
        return self

    def block(self, y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
        if self.turned:
            y0, y1, x0, x1 = x0, x1, y0, y1
        width = self.shape[0] if self.turned else self.shape[1]
        size = self.dtype.itemsize
        if x1 - x0 < width // 4:
            rows = self.src.many([(self.begin + (y * width + x0) * size, (x1 - x0) * size) for y in range(y0, y1)])
            data = np.frombuffer(b"".join(rows), self.dtype).reshape(y1 - y0, x1 - x0)
        else:
            data = np.frombuffer(self.src.get(self.begin + y0 * width * size, (y1 - y0) * width * size), self.dtype).reshape(y1 - y0, width)[:, x0:x1]
        return Raster(data.T if self.turned else data, nodata=self.nodata).values


def npy(url: str, options: dict) -> Npy:
    return Npy(url, options.get("nodata"))


def constant(url: str, options: dict) -> Raster:
    """const://height/width/value"""
    h, w, v = url.removeprefix("const://").split("/")
    return Raster(np.full((int(h), int(w)), float(v)))


#: Fixed values of the TIFF format: size and struct code of a field type; sample kinds.
FIELD = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
KIND = {1: "u", 2: "i", 3: "f"}


@dataclass
class Field:
    """A field of a directory: where its numbers are, which are read when they are asked for."""

    src: Ranges
    begin: int
    n: int
    size: int
    code: str
    order: str

    def numbers(self, i: int = 0, j: int | None = None) -> list:
        j = self.n if j is None else j
        raw = self.src.get(self.begin + i * self.size, (j - i) * self.size)
        return list(struct.unpack(f"{self.order}{(j - i) * len(self.code)}{self.code[0]}", raw))

    def text(self) -> str:
        return self.src.get(self.begin, self.n).rstrip(b"\0").decode()


def directories(src: Ranges) -> list[dict[int, Field]]:
    """All directories, of a classic file (4-byte offsets) or a BigTIFF (8 bytes)."""
    order = {b"II": "<", b"MM": ">"}.get(src.get(0, 2))
    version = struct.unpack(order + "H", src.get(2, 2))[0] if order else 0
    if version not in (42, 43):
        raise RuntimeError("not a TIFF file")
    word, count, size_of_entry = ("Q", "Q", 20) if version == 43 else ("I", "H", 12)
    room = struct.calcsize(word)
    one = lambda code, at: struct.unpack(order + code, src.get(at, struct.calcsize(code)))[0]
    at, found, seen = one(word, 8 if version == 43 else 4), [], set()
    while at and at not in seen:
        seen.add(at)
        entries, at = one(count, at), at + struct.calcsize(count)
        table = src.get(at, entries * size_of_entry + room)
        fields = {}
        for i in range(entries):
            tag, kind, n = struct.unpack_from(order + "HH" + word, table, i * size_of_entry)
            if kind in FIELD:
                size, code = FIELD[kind]
                begin = at + i * size_of_entry + 4 + room
                if size * n > room:
                    begin = struct.unpack_from(order + word, table, i * size_of_entry + 4 + room)[0]
                fields[tag] = Field(src, begin, n, size, code, order)
        found.append(fields)
        at = struct.unpack_from(order + word, table, entries * size_of_entry)[0]
    return found


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first; 256 starts over and 257 ends."""
    out, table, width, last = [], [], 9, None
    bits, held = 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
            width = min(12, max(9, (len(table) + 1).bit_length()))
        out.append(word)
        last = word
    return b"".join(out)


def zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


#: By the number that TIFF gives a compression.
DECOMPRESS = {1: bytes, 5: lzw, 8: zlib.decompress, 32946: zlib.decompress, 50000: zstd}


def unpredicted(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """(rows, columns, samples) from differences: of neighbours (2), or of the bytes of a row, sorted by place (3)."""
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor == 3:
        rows, columns, samples = block.shape
        size = block.dtype.itemsize
        raw = np.cumsum(np.ascontiguousarray(block).view(np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        planes = raw.reshape(rows, size, columns * samples)  # the first plane has the highest bytes
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, columns, samples).astype(block.dtype)
    return block


class Tiff:
    """A directory of a GeoTIFF: strips or tiles, plain or compressed, any predictor, one band or one band and alpha.

    Only the tiles under a window are read. Overviews are the file's other directories that say so.
    """

    #: Decoded tiles that are kept for the next window.
    KEPT = 32

    def __init__(self, url: str, src: Ranges, fields: dict[int, Field], overviews: Sequence[dict[int, Field]] = (), base: Tiff | None = None):
        self.url, self.src, self.tiles = url, src, {}
        get = lambda tag, default=None: fields[tag].numbers() if tag in fields else default
        self.width, self.height, bands = get(256)[0], get(257)[0], get(277, [1])[0]
        extra = get(338, [])
        self.alpha = bool(extra) and extra[0] in (1, 2)  # else an extra sample is a band like any other
        if bands != 1 + self.alpha:
            raise RuntimeError(f"{url!r} must have a single band, but has {bands}")
        self.packing, self.predictor = get(259, [1])[0], get(317, [1])[0]
        if self.packing not in DECOMPRESS:
            raise RuntimeError(f"{url!r}: compression {self.packing} is not supported")
        self.order = fields[256].order
        self.dtype = np.dtype(f"{self.order}{KIND[get(339, [1])[0]]}{get(258)[0] // 8}")
        self.tiled = 324 in fields
        self.th, self.tw = (get(323)[0], get(322)[0]) if self.tiled else (min(self.height, get(278, [self.height])[0]), self.width)
        self.offsets, self.counts = (fields[324], fields[325]) if self.tiled else (fields[273], fields[279])
        self.planar = bands > 1 and get(284, [1])[0] == 2
        self.bands, self.per = bands, 1 if self.planar else bands
        self.across, self.down = -(-self.width // self.tw), -(-self.height // self.th)
        self.nodata = float(fields[42113].text()) if 42113 in fields else base.nodata if base else None
        self.epsg, self.transform = (base.epsg, base.transform) if base else (None, None)
        if base and base.transform:
            (a, b, c, d, e, f), sx, sy = base.transform, base.width / self.width, base.height / self.height
            self.transform = (a * sx, b * sy, c, d * sx, e * sy, f)
        elif not base:
            keys = get(34735, [])
            self.epsg = next((keys[i + 3] for want in (3072, 2048) for i in range(4, len(keys), 4) if keys[i] == want and keys[i + 1] == 0), None)
            if 33550 in fields and 33922 in fields:
                (sx, sy), (px, py, _, x, y, *_) = get(33550)[:2], get(33922)
                self.transform = (sx, 0.0, x - px * sx, 0.0, -sy, y + py * sy)
        self.levels = [Tiff(url, src, f, base=self) for f in overviews]

    @property
    def shape(self) -> tuple[int, int]:
        return self.height, self.width

    def at(self, step: float) -> Tiff:
        fit = [o for o in self.levels if max(self.width / o.width, self.height / o.height) <= step * (1 + 1e-6)]
        return min(fit, key=lambda o: o.width, default=self)

    def decoded(self, raw: bytes, rows: int) -> np.ndarray:
        """(samples, rows, columns) of a tile; one without bytes has nothing in it."""
        if not raw:
            return np.full((self.per, rows, self.tw), self.nodata or 0, self.dtype)
        block = np.frombuffer(DECOMPRESS[self.packing](raw), self.dtype)[: rows * self.tw * self.per].reshape(rows, self.tw, self.per)
        return np.moveaxis(unpredicted(block, self.predictor, self.order), 2, 0)

    def raw(self, y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
        """(samples, rows, columns) as they are stored."""
        ty0, ty1, tx0, tx1 = y0 // self.th, -(-y1 // self.th), x0 // self.tw, -(-x1 // self.tw)
        out = np.zeros((self.bands, (ty1 - ty0) * self.th, (tx1 - tx0) * self.tw), self.dtype)
        wanted = [(plane, y, x) for plane in range(self.bands // self.per) for y in range(ty0, ty1) for x in range(tx0, tx1)]
        todo, spans = [k for k in wanted if k not in self.tiles], []
        for plane, y in dict.fromkeys(k[:2] for k in todo):  # the index of a row of tiles stands together
            i = (plane * self.down + y) * self.across
            index = list(zip(self.offsets.numbers(i + tx0, i + tx1), self.counts.numbers(i + tx0, i + tx1), strict=True))
            spans += [index[x - tx0] for p, r, x in todo if (p, r) == (plane, y)]
        new = {k: self.decoded(raw, self.th if self.tiled else min(self.th, self.height - k[1] * self.th)) for k, raw in zip(todo, self.src.many(spans), strict=True)}
        for plane, y, x in wanted:
            tile = new[plane, y, x] if (plane, y, x) in new else self.tiles[plane, y, x]
            out[plane : plane + self.per, (y - ty0) * self.th : (y - ty0) * self.th + tile.shape[1], (x - tx0) * self.tw : (x - tx0 + 1) * self.tw] = tile
        if len(wanted) <= self.KEPT:
            self.tiles = {k: new[k] if k in new else self.tiles[k] for k in wanted}
        top, left = ty0 * self.th, tx0 * self.tw
        return out[:, y0 - top : y1 - top, x0 - left : x1 - left].astype(self.dtype.newbyteorder("="))

    def block(self, y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
        raw = self.raw(y0, y1, x0, x1)
        return Raster(raw[0], nodata=self.nodata, alpha=raw[1] if self.alpha else None).values

    @property
    def data(self) -> np.ndarray:
        return self.raw(0, self.height, 0, self.width)[0]

    @property
    def values(self) -> np.ndarray:
        return self.block(0, self.height, 0, self.width)


def geotiff(url: str, options: dict, source: Callable[[str], Ranges] = Ranges) -> Tiff:
    """With the option ``overviews=False`` the file is always read at its own resolution."""
    src = source(url)
    first, *others = directories(src)
    reduced = [f for f in others if 254 in f and f[254].numbers()[0] & 5 == 1]  # overviews, but not those of a mask
    return Tiff(url, src, first, reduced if options.get("overviews", True) else ())


def pick(url: str, options: dict) -> Dataset:
    """By scheme or ending."""
    if url.startswith("const://"):
        return constant(url, options)
    return npy(url, options) if url.endswith(".npy") else geotiff(url, options)
