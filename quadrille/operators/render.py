"""Tiles as PNG: display ranges, colours and transparency are columns; only the encoding of a tile is Python."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..functions.frames import ship

#: Corner colours of the default colour map, dark to light; the table between them is interpolated.
STOPS = ((68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37))


def colour_table(stops: Sequence[tuple[int, int, int]] = STOPS, n: int = 256) -> np.ndarray:
    at = np.linspace(0, len(stops) - 1, n)
    return np.stack([np.interp(at, np.arange(len(stops)), [s[i] for s in stops]) for i in range(3)], 1).round().astype(np.uint8)


def check_display(n_bands: int, vrange: tuple[float, float] | None, cmap) -> None:
    if not 1 <= n_bands <= 3:
        raise ValueError(f"1 to 3 bands can be shown, not {n_bands}")
    if cmap is not None and n_bands != 1:
        raise ValueError(f"a colour map needs a single band, but `band` has {n_bands}")
    if vrange is not None and not vrange[0] <= vrange[1]:
        raise ValueError(f"range must ascend: {vrange}")


def rgba(bands: DataFrame, names: Sequence[str], vrange: tuple, checkerboard: bool = True, cmap: Sequence | None = None) -> DataFrame:
    """A column for each band -> r, g, b, a. Of two bands the first is also the third; missing pixels are transparent."""
    check_display(len(names), None, cmap)
    v = [values.normalise(F.col(n), *vrange) for n in names]
    valid = F.lit(True)
    for n in names:
        valid = valid & F.col(n).isNotNull()
    if cmap is not None:
        at = F.when(v[0].isNotNull(), F.least(F.greatest(F.floor(v[0] * 256), F.lit(0)), F.lit(255)).cast("int") + 1)
        shades = [F.coalesce(F.element_at(F.array(*[F.lit(int(c[i])) for c in cmap]), at), F.lit(0)) for i in range(3)]
    else:
        shades = [values.quantise(x) for x in v]
        shades = shades * 3 if len(v) == 1 else [*shades, shades[0]] if len(v) == 2 else shades
    a = values.alpha(valid, F.col("iy"), F.col("ix"), checkerboard)
    keep = [c for c in bands.columns if c not in names]
    return bands.select(*keep, *[s.cast("int").alias(c) for s, c in zip([*shades, a], "rgba", strict=True)])


def checkerboard(shape: tuple[int, int], size: int = 8) -> np.ndarray:
    y, x = np.indices(shape)
    return (y // size + x // size) % 2 == 0


def png(image: np.ndarray) -> bytes:
    """An (h, w, 4) array of bytes as a PNG."""
    h, w, _ = image.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * 4).astype(np.uint8)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def empty_tile(size: int = 256, checker: bool = True) -> bytes:
    image = np.zeros((size, size, 4), np.uint8)
    if checker:
        image[..., 3] = np.where(checkerboard((size, size)), 30, 0)
    return png(image)


def encode_tiles(pixels: DataFrame, keys: Sequence[str], shape: tuple[int, int]) -> DataFrame:
    """Rows (keys, iy, ix, r, g, b, a) -> a PNG for each key; a tile is of bounded size, pixels without a row are empty."""
    cols = list(keys)
    schema = ", ".join(f"`{c}` {t}" for c, t in pixels.select(*cols).dtypes) + ", png binary"

    def one(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((*shape, 4), np.uint8)
        image[d["iy"], d["ix"]] = d[["r", "g", "b", "a"]].to_numpy()
        return pd.DataFrame([[*key, png(image)]], columns=[*cols, "png"])

    ship(pixels.sparkSession)
    return pixels.groupBy(*cols).applyInPandas(one, schema)


def default_range(px: DataFrame, value: str = "v", exact: bool = False) -> tuple[float, float]:
    """2nd and 98th percentile: two numbers come to the driver."""
    from .reduce import percentiles

    r = percentiles(px, value=value, exact=exact).head()
    return r[0], r[1]


def token(*parts: Column) -> Column:
    """A name that depends on what is shown, and only on that."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)
