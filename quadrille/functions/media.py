"""Media types of assets, and other small string functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The media types that are stacked by default.
RASTER_TYPES = ("image/tiff", "image/x.geotiff", "image/vnd.stac.geotiff", "image/jp2")


def parse_type(s: Column) -> Column:
    """struct(type, subtype, params): "image/tiff; application=geotiff". More than one "/" is an error."""
    parts = F.transform(F.split(s, ";"), lambda p: F.trim(p))
    head = F.split(F.element_at(parts, 1), "/")
    head = F.when(F.size(head) > 2, F.raise_error(F.concat(F.lit("not a media type: "), s)).cast("array<string>")).otherwise(head)
    return F.when(s.isNotNull(), F.struct(F.get(head, 0).alias("type"), F.get(head, 1).alias("subtype"), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))).alias("params")))


def split_type(s: str) -> tuple[str, str | None, frozenset[str]]:
    first, *params = (p.strip() for p in s.split(";"))
    kind, *sub = first.split("/")
    if len(sub) > 1:
        raise AssertionError(f"not a media type: {s}")
    return kind, sub[0] if sub else None, frozenset(params)


def accepts(parsed: Column, target: str) -> Column:
    """Whether a type is the target or a special case of it: a target without subtype takes any."""
    kind, sub, params = split_type(target)
    ok = parsed["type"] == kind
    if sub is not None:
        ok &= parsed["subtype"] == sub
    if params:
        ok &= F.size(F.array_except(F.array(*map(F.lit, sorted(params))), parsed["params"])) == 0
    return F.coalesce(ok, F.lit(False))


def accepts_any(parsed: Column, targets: Iterable[str]) -> Column:
    out = F.lit(False)
    for t in targets:
        out = out | accepts(parsed, t)
    return out


def notebook_base(url: Column) -> Column:
    """What stands before /lab, /notebook or /voila."""
    return F.nullif(F.regexp_extract(url, r"(^.+?)\/(?:lab|notebook|voila)", 1), F.lit(""))


def tile_url(base: Column, port, token: Column) -> Column:
    return F.format_string("%s/proxy/%d/%s/{z}/{y}/{x}.png", base, F.lit(port), token)
