import json
import random

import pytest
from pyspark.sql import functions as F

from quadrille.functions import metadata
from quadrille.functions.frames import numbered
from quadrille.sources import items as sources


def test_numbers_follow_the_order_over_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["", "b", "a", None, "c"]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long").repartition(7)
    got = numbered(df, [F.col("k").desc(), F.col("i")], "n").collect()
    want = sorted(rows, key=lambda r: (r[0] is None, [-ord(c) for c in r[0] or ""] or [1], r[1]))
    assert [(r["k"], r["i"]) for r in sorted(got, key=lambda r: r["n"])] == want
    assert sorted(r["n"] for r in got) == list(range(500)) and dict(df.dtypes) | {"n": "int"} == dict(numbered(df, [F.col("i")], "n").dtypes)
    assert numbered(df.limit(0), [F.col("i")], "n").collect() == []


def test_constant_fields_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for g in "pq":
        for item in range(40):
            rows += [(g, item, "same", "v"), (g, item, "none", None), (g, item, "mixed", rng.choice("ab")), (g, item, "null once", None if item == 3 else "x")]
            rows += [(g, item, "rare", "r")] * (item % 2) + [(g, item, "twice", "t")] * 2
    got = {(r["g"], r["key"]): (r["is_constant"], r["value"]) for r in metadata.constants(spark.createDataFrame(rows, "g string, item int, key string, value string"), ["g"]).collect()}
    want = {"same": (True, "v"), "none": (True, None), "mixed": (False, None), "null once": (False, None), "rare": (False, None), "twice": (True, "t")}
    assert got == {(g, k): v for g in "pq" for k, v in want.items()}
    whole = metadata.constants(spark.createDataFrame(rows, "g string, item int, key string, value string"))
    assert {r["key"]: r["is_constant"] for r in whole.collect()} == {k: v[0] for k, v in want.items()}


@pytest.mark.parametrize("by", [["g"], []])
def test_fields_of_odd_keys_and_values(spark, by):
    rng = random.Random(4)
    rows = [(rng.choice(["p", "q", None]) if by else "p", rng.choice([*range(30), None]), k, rng.choice([None, "a", "b"][:n])) for k, n in ((None, 3), ("", 2), ("none", 1), ("mixed", 3)) for _ in range(300)]
    rows += [("p", i, "all", "x") for i in [*range(30), None]]
    df = spark.createDataFrame(rows, "g string, item int, key string, value string")
    got = {(r["g"] if by else "p", r["key"]): (r["is_constant"], r["value"]) for r in metadata.constants(df, by).collect()}
    want, same = {}, {}
    for g, k in {(r[0], r[2]) for r in rows}:
        items = {r[1] for r in rows if r[0] == g}
        values = [r[3] for r in rows if r[0] == g and r[2] == k]
        every, one = {r[1] for r in rows if r[0] == g and r[2] == k} == items, len(set(values)) == 1
        want[g, k] = (every and one, values[0] if every and one else None)
        if one and values[0] is not None:
            same[g, k] = values[0]
    assert got == {k: v for k, v in want.items() if k[0] is not None}  # a group without a name is left out, as by SQL's join
    assert {(r["g"] if by else "p", r["key"]): r["value"] for r in metadata.all_same(df, by).collect()} == same
    assert metadata.constants(df.limit(0), by).collect() == metadata.all_same(df.limit(0), by).collect() == []


def test_partitions_of_fields_grow_with_the_rows(spark, monkeypatch, capsys):
    """rows were dealt to as many partitions as Spark made by compressed size, and sorted there twice."""
    monkeypatch.setattr(metadata, "ROWS", 100, raising=False)
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), F.col("id").alias("item"), F.lit("k").alias("key"), F.lit("v").alias("value"))
    out = metadata.constants(df, ["g"])
    assert sorted(map(tuple, out.collect())) == [(0, "k", True, "v"), (1, "k", True, "v")]
    out.explain()
    plan = capsys.readouterr().out
    assert ", 21), REPARTITION_BY_NUM" in plan and not any("SortAggregate" in x and "item" in x for x in plan.splitlines())


def test_what_is_left_to_then_is_made_once(spark):
    """F8: finding the ranges read all rows, parsed items included, a second time."""
    seen = spark.sparkContext.accumulator(0)

    def count(i):
        seen.add(1)
        return i

    counted = F.udf(count, "long")
    got = numbered(spark.range(300).withColumnRenamed("id", "i"), [F.col("i").desc()], "n", lambda d: d.withColumn("c", counted("i"))).collect()
    assert seen.value == 300 and all(r["n"] == 299 - r["i"] and r["c"] == r["i"] for r in got)


def test_items_are_ordered_before_they_are_parsed_as_after(spark):
    items = [{"id": "a", "properties": {"datetime": "2020-02-01"}}, {"id": "b", "properties": {}}, {"id": "c"}, {"id": "d", "properties": {"datetime": "2020-01-01"}}, {"id": "e", "properties": {"datetime": None, "x": [1]}}]
    odd = spark.createDataFrame([(i, t) for i, t in enumerate([*map(json.dumps, items), "no json", "", None, '{"id": "f", "bbox": 7, "properties": {"datetime": 5}}'])], "item_idx long, json string")
    plain = lambda d: {r["item_idx"]: (r["time_idx"], r["id"], r["properties"]) for r in d.collect()}
    for by in ("asc", "desc", False):
        assert plain(sources.ordered_rows(spark, odd, by)) == plain(sources.ordered(sources.rows(spark, odd), by))
