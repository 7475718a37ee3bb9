"""Catalogues as files: documents with links to others become items, a job a level, without a list of them on the driver."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import materialised, numbered, ship
from .env import MISSING, tolerated

#: Links that are followed, with their place among a document's: its own items and further pages come before its children.
FOLLOWED = {"item": 0, "items": 0, "next": 0, "child": 1}

DOCUMENT = "url string, place array<int>, items array<string>, links array<struct<url string, place array<int>>>"


def fetched(url: str) -> bytes:
    """A document by a path or any address that pyarrow's file systems know."""
    import pyarrow.fs as pafs

    fs, path = pafs.FileSystem.from_uri(url if "://" in url else f"file://{url}")
    with fs.open_input_stream(path) as f:
        return f.read()


def parsed(url: str, place: Sequence[int], text: bytes) -> dict:
    """A document's items, as JSON, and its links with their places. What is no item, collection or catalogue has neither."""
    doc = json.loads(text)
    if not isinstance(doc, dict):
        return {"url": url, "place": list(place), "items": [], "links": []}
    kind = doc.get("type")
    found = [doc] if kind == "Feature" else [f for f in doc.get("features") or [] if isinstance(f, dict)] if kind == "FeatureCollection" else []
    links = []
    for i, link in enumerate(doc.get("links") or [] if kind != "Feature" else []):
        if isinstance(link, dict) and link.get("rel") in FOLLOWED and link.get("href"):
            links.append({"url": urljoin(url, link["href"]).split("#")[0], "place": [*place, FOLLOWED[link["rel"]], i]})
    return {"url": url, "place": list(place), "items": [json.dumps(f) for f in found], "links": links}


def stored(url: str, text: str) -> None:
    import pyarrow.fs as pafs

    fs, path = pafs.FileSystem.from_uri(url if "://" in url else f"file://{url}")
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(text.encode())


def publish(items: DataFrame, folder: str, per_page: int = 1000, fan: int = 100) -> str:
    """Writes items (item_idx, json) as a static catalogue and gives its root: pages of features below levels of links.

    A page holds the items of ``per_page`` numbers and a document links at most ``fan`` others, so no task gets an unbounded
    group. Rows without a number or JSON are left out, and ``crawl`` of the root gives the others in their order. A task that
    is repeated writes the same files again.
    """
    spark, folder = items.sparkSession, folder.rstrip("/")
    ship(spark)

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, text in zip(batch.column("url").to_pylist(), batch.column("text").to_pylist(), strict=True):
                stored(url, text)
            yield batch.select(["node"])

    def name(level: int) -> Column:
        return F.concat(F.lit(f"{level}/"), F.col("node").cast("string"), F.lit(".json"))

    def written(docs: DataFrame, level: int) -> DataFrame:
        return materialised(docs.select("node", F.concat(F.lit(f"{folder}/"), name(level)).alias("url"), "text").mapInArrow(put, "node long"))

    rows = items.filter("item_idx IS NOT NULL AND json IS NOT NULL").select(F.floor(F.col("item_idx") / per_page).alias("node"), F.struct("item_idx", "json").alias("i"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["json"]), ",")
    nodes = written(rows.groupBy("node").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), texts, F.lit("]}")).alias("text")), 0)
    level, rel = 0, "items"
    while True:
        link = F.concat(F.lit(f'{{"rel":"{rel}","href":"../'), name(level), F.lit('"}'))
        up = nodes.select(F.floor(F.col("node") / fan).alias("up"), F.struct("node", link.alias("text")).alias("l"))
        texts = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda v: v["text"]), ",")
        docs = up.groupBy(F.col("up").alias("node")).agg(F.concat(F.lit('{"type":"Catalog","links":['), texts, F.lit("]}")).alias("text"))
        level, rel = level + 1, "child"
        nodes = written(docs, level)
        first, last = nodes.agg(F.min("node"), F.max("node")).head()
        if first is None:
            stored(f"{folder}/{level}/0.json", '{"type":"Catalog","links":[]}')
        if first is None or first == last:
            return f"{folder}/{level}/{first or 0}.json"


def crawl(spark: SparkSession, roots: str | Sequence[str], fetch: Callable[[str], bytes] = fetched, errors_as_missing: Iterable[BaseException] = MISSING) -> DataFrame:
    """(item_idx, url, json) of every item that the links of the given documents lead to.

    Each level of links is one job over the documents that no level before has opened, so cycles end and a document that is
    linked more than once is opened once, at the least place of its level. Items are numbered as a walk meets them that takes a
    document's own ones, then those it links, then those of its children. Of a collection of features each is an item; an
    identifier that occurs twice gives two items. Documents whose errors match ``errors_as_missing`` count as empty, others
    raise; without any item the frame has no rows. Only counts of links come to the driver.
    """
    ship(spark)
    errors = list(errors_as_missing)

    def opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, place in zip(batch.column("url").to_pylist(), batch.column("place").to_pylist(), strict=True):
                try:
                    rows.append(parsed(url, place, fetch(url)))
                except Exception as e:
                    tolerated(e, errors, url, "opening")
            if rows:
                link = pa.list_(pa.struct([("url", pa.string()), ("place", pa.list_(pa.int32()))]))
                schema = pa.schema([("url", pa.string()), ("place", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("links", link)])
                yield pa.RecordBatch.from_pylist(rows, schema)

    first = [roots] if isinstance(roots, str) else list(roots)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frontier = spark.createDataFrame([(u, [i]) for i, u in enumerate(first)], "url string, place array<int>").groupBy("url").agg(F.min("place").alias("place"))
    levels, seen = [], None
    while True:
        frontier = materialised(frontier)
        if frontier.isEmpty():
            break
        seen = frontier.select("url") if seen is None else seen.unionByName(frontier.select("url"))
        level = materialised(frontier.repartition(parts, "url").mapInArrow(opened, DOCUMENT))
        levels.append(level.select("url", "place", "items"))
        links = level.select(F.explode("links").alias("l")).select("l.*").groupBy("url").agg(F.min("place").alias("place"))
        frontier = links.join(seen, "url", "left_anti")
    if not levels:
        return spark.createDataFrame([], "item_idx int, url string, json string")
    documents = levels[0]
    for level in levels[1:]:
        documents = documents.unionByName(level)
    items = documents.select("url", "place", F.posexplode("items").alias("_i", "json"))
    return numbered(items, [F.col("place"), F.col("_i")], "item_idx").select("item_idx", "url", "json")
