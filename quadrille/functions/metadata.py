"""Item and asset metadata: which fields are constant, which agree, times, and unpacking of nested fields."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import media
from .frames import materialised, numbered

EO_BANDS = "array<struct<name:string,common_name:string,description:string,center_wavelength:double,full_width_half_max:double>>"


def utc(text: Column) -> Column:
    """ISO 8601 with any offset -> naive UTC; null stays null and nonsense raises. Needs a UTC session time zone."""
    return F.to_timestamp(text).cast("timestamp_ntz")


def select_by_type(assets: DataFrame, allowed: Iterable[str]) -> DataFrame:
    """Assets (asset, type, ordinal) that have a type somewhere and whose every type is allowed, with first ordinal."""
    ok = media.accepts_any(media.parse_type(F.col("type")), allowed)
    types = assets.groupBy("asset", "type").agg(F.min("ordinal").alias("first"))  # few distinct types are then parsed
    out = types.groupBy("asset").agg(F.count("type").alias("n_types"), F.bool_and(F.when(F.col("type").isNotNull(), ok)).alias("ok"), F.min("first").alias("first"))
    return out.filter("n_types > 0 AND ok").drop("ok")


def first_known(options: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first option that isn't null, and its name."""
    origin = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in options])
    return F.coalesce(*[c for _, c in options]), origin


def inherited(asset: Column, properties: Column, key: str) -> Column:
    """An asset's field, which counts even if it is explicitly null, else the item's."""
    return F.when(F.map_contains_key(asset, key), asset[key]).otherwise(properties[key])


def reindex(rows: DataFrame, label: str, index: str, order: str | None = None) -> DataFrame:
    """Numbers the labels that are left from 0 on, in the order given: an axis without empty places."""
    axis = rows.groupBy(label).agg(F.min(order or label).alias("_o"))
    return rows.join(numbered(axis, [F.col("_o")], index).drop("_o"), label)


#: Rows of fields that are dealt to one partition, as the keys of a hash table.
ROWS = 1 << 20


def field_values(fields: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long fields (key, value) -> key, _n, _nn, _v, _w: rows, values, least and greatest value.

    Equal values are counted first, by hash: the least and greatest text take a sort, of what is left after that.
    """
    f = fields.groupBy(*by, "key", "value").agg(F.count(F.lit(1)).alias("_n"))
    known = F.when(F.col("value").isNotNull(), F.col("_n")).otherwise(F.lit(0))
    return f.groupBy(*by, "key").agg(F.sum("_n").alias("_n"), F.sum(known).alias("_nn"), F.min("value").alias("_v"), F.max("value").alias("_w"))


def constants(fields: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long fields (item, key, value) -> key, is_constant, value: whether every item has the field with one value.

    Rows are dealt out by item to find the items of each key; values need no exchange of all rows. The number of partitions
    grows with the rows: Spark would join partitions by their compressed size, and these rows are much larger in memory.
    """
    f = materialised(field_values(fields, by))  # one row a field
    rows = f.agg(F.sum("_n")).head()[0] or 0
    dealt = fields.repartition(max(fields.sparkSession.sparkContext.defaultParallelism, rows // ROWS + 1), *by, "item")
    items = dealt.select(*by, "item").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_items"))
    have = dealt.select(*by, "item", "key").distinct().groupBy(*by, "key").agg(F.count(F.lit(1)).alias("_have"))
    f = f.unionByName(have, allowMissingColumns=True).groupBy(*by, "key").agg(*[F.max(c).alias(c) for c in ("_have", "_n", "_nn", "_v", "_w")])
    f = f.join(items, list(by)) if by else f.crossJoin(F.broadcast(items))  # one row
    every, one, none = F.col("_have") == F.col("_items"), (F.col("_v") == F.col("_w")) & (F.col("_nn") == F.col("_n")), F.col("_nn") == 0
    one = F.coalesce(one, F.lit(False))
    return f.select(*by, "key", (every & (one | none)).alias("is_constant"), F.when(every & one, F.col("_v")).alias("value"))


def all_same(fields: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fields that are equal in every item that has them; an explicit null or another value drops the field."""
    return field_values(fields, by).filter("_v = _w AND _nn = _n").select(*by, "key", F.col("_v").alias("value"))


def eo_band(text: Column) -> Column:
    """The band of a JSON list that has exactly one; else null."""
    bands = F.from_json(text, EO_BANDS)
    return F.when(F.size(bands) == 1, F.get(bands, 0))


def field(of: Column, key: str) -> Column:
    """A field of a variant object."""
    return F.try_variant_get(of, f'$["{key}"]' if '"' not in key else f"$['{key}']", "variant")


def labels(items: DataFrame, keys: Sequence[str], typed: str = "typed", text: str = "properties") -> dict[str, Column]:
    """By field, a column of values of the type that it has in all items; null where an item doesn't have it.

    Whole numbers, other numbers, truth values and texts keep their type; what is of different types, and objects, become
    JSON text. Lists of one element in every item are that element. If all items have the same longer list of scalars, it
    is a label, as its sorted distinct elements; lists of different lengths stay lists; lists of lists, and different ones
    of the same length, would be an axis of their own and are left out.
    """
    safe = [k for k in keys if not ('"' in k and "'" in k)]
    out = {k: F.col(text)[k] for k in keys if k not in safe}
    if not safe:
        return out
    one = items.agg(F.count(F.lit(1)).alias("n"), *[F.schema_of_variant_agg(field(F.col(typed), k)).alias(f"k{i}") for i, k in enumerate(safe)]).head()  # names of types
    lists = {}
    for i, k in enumerate(safe):
        kind, value = one[f"k{i}"] or "VOID", field(F.col(typed), k)
        if kind.startswith("ARRAY<") and not kind.startswith(("ARRAY<ARRAY", "ARRAY<OBJECT")):
            lists[k] = scalar(kind[6:-1])
        elif kind.startswith(("ARRAY", "OBJECT", "VARIANT")):
            if not kind.startswith("ARRAY"):
                out[k] = F.when(~F.is_variant_null(value), F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))
        else:
            out[k] = F.try_variant_get(value, "$", scalar(kind))
    if lists:
        of = {k: F.try_variant_get(field(F.col(typed), k), "$", f"array<{t}>") for k, t in lists.items()}
        fact = lambda c: F.struct(F.min(F.size(c)).alias("least"), F.max(F.size(c)).alias("most"), F.count(c).alias("n"), (F.min(F.to_json(c)) == F.max(F.to_json(c))).alias("same"))
        got = items.agg(*[fact(c).alias(f"f{i}") for i, c in enumerate(of.values())]).head()  # a few numbers a field
        for i, (k, c) in enumerate(of.items()):
            f = got[f"f{i}"]
            if f["least"] == f["most"] == 1:
                out[k] = F.get(c, 0)
            elif f["same"] and f["n"] == one["n"]:
                out[k] = F.array_sort(F.array_distinct(c))
            elif f["least"] != f["most"] or f["n"] < one["n"]:
                out[k] = c
    return {k: out[k] for k in keys if k in out}


def scalar(kind: str) -> str:
    """The Spark type of a variant's type."""
    if kind.startswith("DECIMAL") or kind in ("FLOAT", "DOUBLE"):
        return "double"
    return {"BIGINT": "bigint", "BOOLEAN": "boolean"}.get(kind, "string")


def canonical(value) -> str | None:
    """JSON in which equal values look alike: 1, 1.0 and true are one, keys are sorted."""
    if value is None:
        return None

    def plain(v):
        if isinstance(v, bool):
            return int(v)
        if isinstance(v, float) and v.is_integer():
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list | tuple) else v

    return json.dumps(plain(value), sort_keys=True)


def flat(value):
    """A metadata value as a label: one-element lists are unwrapped, longer ones of scalars become sorted distinct tuples.

    Mappings, ragged lists and lists of lists are no labels: None.
    """
    while isinstance(value, list | tuple) and len(value) == 1:
        value = value[0]
    if isinstance(value, list | tuple):
        if not value or any(isinstance(v, list | tuple | dict) for v in value):
            return None
        return tuple(sorted(set(value), key=lambda v: (str(type(v)), v)))
    return None if isinstance(value, dict) else value


def label(text: str) -> str | None:
    """The text of a field as a label: a list of JSON is made flat, everything else stays."""
    try:
        value = json.loads(text) if text.startswith("[") else text
    except ValueError:
        return text
    value = flat(value)
    return value if isinstance(value, str) or value is None else json.dumps(value, ensure_ascii=False)
