"""Items as rows: from dicts, item objects, catalogues, JSON files or frames of JSON text."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import numbered

SCHEMA = "id string, collection string, bbox array<double>, properties map<string,string>, assets map<string,map<string,string>>"


def to_plain(items: Any) -> list[dict]:
    """A list of dicts from a dict, an item, a collection, a catalogue (with all its children) or a sequence of items."""

    def one(item: Any) -> dict:
        if isinstance(item, Mapping):
            return dict(item)
        if hasattr(item, "to_dict"):
            return item.to_dict()
        if isinstance(getattr(item, "_data", None), Mapping):
            return item._data
        raise TypeError(f"{item!r} is no item: dicts and objects with to_dict() are")

    if isinstance(items, Mapping):
        return [dict(i) for i in items["features"]] if items.get("type") == "FeatureCollection" else [dict(items)]
    if isinstance(items, Sequence) and not isinstance(items, str | bytes):
        return [one(i) for i in items]
    if hasattr(items, "get_all_items"):
        return [one(i) for i in items.get_all_items()]
    if hasattr(items, "to_dict") or isinstance(getattr(items, "_data", None), Mapping):
        if hasattr(items, "__iter__"):
            return [one(i) for i in items]
        return [one(items)]
    if hasattr(items, "__iter__") and not isinstance(items, str | bytes):
        return [one(i) for i in items]
    raise TypeError(f"{items!r} holds no items that can be read")


def texts(spark: SparkSession, items: Any) -> DataFrame:
    """item_idx and json.

    A frame must have a column ``json`` and may have ``item_idx``; a string is a path to JSON lines. Frames stay
    distributed: only plain Python items pass through the driver, where they are already.
    """
    if isinstance(items, str):
        items = spark.read.text(items).withColumnRenamed("value", "json")
    if not isinstance(items, DataFrame):
        plain = [(i, json.dumps(x)) for i, x in enumerate(to_plain(items))]
        items = spark.createDataFrame(plain, "item_idx long, json string")
    elif "item_idx" not in items.columns:
        items = items.withColumn("item_idx", F.monotonically_increasing_id())
    return items.select("item_idx", "json")


def parsed(texts: DataFrame) -> DataFrame:
    """id, collection, bbox, properties and assets (values as JSON text), typed (properties as a variant), with item_idx."""
    typed = F.try_variant_get(F.try_parse_json("json"), "$.properties", "variant").alias("typed")
    return texts.select("item_idx", F.from_json("json", SCHEMA).alias("i"), typed).select("item_idx", "i.*", "typed")


def rows(spark: SparkSession, items: Any) -> DataFrame:
    """The items of ``texts``, ``parsed``, in order."""
    return parsed(texts(spark, items))


def by_time(key: Column, by_date: str | bool) -> list[Column]:
    """An order by the raw date text, missing ones as "", ties in the order given; False keeps the order."""
    if by_date not in ("asc", "desc", False):
        raise ValueError(f"sortby_date must be 'asc', 'desc' or False, not {by_date!r}")
    key = F.coalesce(key, F.lit(""))
    return [F.col("item_idx")] if by_date is False else [key.asc() if by_date == "asc" else key.desc(), F.col("item_idx")]


def ordered_rows(spark: SparkSession, items: Any, by_date: str | bool = "asc") -> DataFrame:
    """``ordered(rows(spark, items), by_date)``: only dates are parsed to find the order, the rest once, after the exchange."""
    dated = texts(spark, items).withColumn("_date", F.from_json("json", SCHEMA)["properties"]["datetime"])
    return numbered(dated, by_time(F.col("_date"), by_date), "time_idx", parsed)


def ordered(items: DataFrame, by_date: str | bool = "asc") -> DataFrame:
    """Adds time_idx: by the raw date text, missing ones as "", ties in the order given; False keeps the order."""
    return numbered(items, by_time(F.col("properties")["datetime"], by_date), "time_idx")
