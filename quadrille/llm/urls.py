"""URL filter: a trie over reversed host labels, then path segments, in a broadcast; the longest match decides."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ship

#: (verdict, host, path); an entry fits its host and all subdomains.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
FOLD = str.maketrans(UPPER, LOWER)


@dataclass
class Node:
    hosts: dict[str, Node] = field(default_factory=dict)
    paths: Node | None = None
    segments: dict[str, Node] = field(default_factory=dict)
    #: what the next segment must start with -> (rule, verdict)
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)


def build(rules: Iterable[tuple[str, str, str]]) -> Node:
    """A rule's path "/a/b" is the whole segment "a" and an end "b", which is a prefix of the segment that follows."""
    root = Node()
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.translate(FOLD).split(".")):
            node = node.hosts.setdefault(label, Node())
        node.paths = node = node.paths or Node()
        *whole, last = path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        node.ends[last] = (f"{host}{path}", verdict)
    return root


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(FOLD), slash + path


def deepest(node: Node, segments: list[str]) -> tuple[str, str] | None:
    best = None
    for segment in segments:
        fits = [e for e in node.ends if segment.startswith(e)]
        if fits:
            best = node.ends[max(fits, key=len)]
        node = node.segments.get(segment)
        if node is None:
            return best
    return best


def lookup(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """The rule with the most host labels wins, then the one with the longest path."""
    node, best, segments = root, None, path.split("/")
    for label in reversed(host.split(".")):
        node = node.hosts.get(label)
        if node is None:
            break
        if node.paths is not None:
            best = deepest(node.paths, segments) or best
    return best


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule and verdict of every row; rules are the user's list, so the trie may be broadcast.

    A null url or one without "://" has an empty host and path and gets the default verdict, as do urls that no rule
    fits. Repeated rows are judged each; long urls are read whole; other columns, whatever their names, are not read. An
    empty table gives an empty result. Longest match: of the rules that fit, those of the most host labels, and of these
    the one of the longest path. (The SQL takes the longest host and path together, which is the same for RULES.)
    """
    spark = pages.sparkSession
    ship(spark)
    trie = spark.sparkContext.broadcast(build(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = trie.value
        for b in batches:
            hosts, paths, names, verdicts = [], [], [], []
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                found = lookup(root, host, path)
                hosts.append(host)
                paths.append(path)
                names.append(found[0] if found else None)
                verdicts.append(found[1] if found else default)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts)]], ["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


ORACLE = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
s AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM s JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(v, 'allow') AS verdict FROM s LEFT JOIN m USING (page_id)
"""
