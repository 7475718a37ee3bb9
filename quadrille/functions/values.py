"""Pixel values: masks, rescaling, ratios and display. Missing is NULL inside the engine; NaN and fills are boundary forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def mask(v: Column, nodata=None, alpha: Column | None = None) -> Column:
    """Null where the value is the dataset's nodata, or where its alpha is 0."""
    out = v if nodata is None else F.nullif(v, nodata if isinstance(nodata, Column) else F.lit(nodata))
    return out if alpha is None else F.when(alpha != 0, out)


def rescale(v: Column, scale, offset) -> Column:
    return v * scale + offset


def fill(v: Column, value) -> Column:
    return F.coalesce(v, F.lit(value))


def ratio(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), null where the sum is 0."""
    return F.try_divide(a - b, a + b)


def normalise(v: Column, vmin, vmax) -> Column:
    """To 0..1 over a display range; 0 everywhere for an empty range. Nulls stay."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (vmin, vmax))
    return F.when(v.isNotNull(), F.when(lo == hi, F.lit(0.0)).otherwise(F.try_divide(v - lo, hi - lo)))


def quantise(v: Column) -> Column:
    """0..1 to 0..255, truncated; outside values are clipped and missing ones are 0."""
    return F.floor(F.least(F.greatest(F.coalesce(v * 255, F.lit(0.0)), F.lit(0.0)), F.lit(255.0))).cast("int")


def checker(iy: Column, ix: Column, size: int = 8) -> Column:
    return F.pmod(F.floor(iy / size) + F.floor(ix / size), F.lit(2)) == 0


def alpha(valid: Column, iy: Column, ix: Column, checkerboard: bool = True) -> Column:
    return F.when(valid, 255).when(checker(iy, ix), 30 if checkerboard else 0).otherwise(0)


def check_fill(dtype, fill_value, strict: bool = False) -> None:
    """Whether a fill can be held: by its value, or with ``strict`` by the type it has."""
    dtype = np.dtype(dtype)
    ok = np.can_cast(np.asarray(fill_value).dtype if not strict else type(fill_value), dtype)
    if not strict and not ok:
        with np.errstate(all="ignore"):
            cast = np.asarray(fill_value).astype(dtype)
        ok = bool(cast == fill_value) or (dtype.kind == "f" and np.isnan(float(fill_value)))
    if not ok:
        raise ValueError(f"{dtype} can't hold the fill_value {fill_value}")


def check_scale(dtype, scale, offset, strict: bool = False) -> None:
    dtype = np.dtype(dtype)
    for name, v in (("scale", scale), ("offset", offset)):
        if not (np.can_cast(type(v), dtype) if strict else dtype.kind == "f" or float(v).is_integer()):
            raise ValueError(f"{dtype} can't hold the {name} {v}; leave out rescale")


#: Spark type of a NumPy dtype; unsigned types go to the next wider signed one.
SPARK_TYPES = {"float64": "double", "float32": "float", "float16": "float", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "bool": "boolean"}


def spark_type(dtype) -> str:
    name = np.dtype(dtype).name
    if name not in SPARK_TYPES:
        raise ValueError(f"dtype {name} has no Spark type")
    return SPARK_TYPES[name]
