import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import mosaic, reduce
from quadrille.plans import catalogue

NAN = float("nan")


def test_quantiles_of_groups_equal_numpy(spark):
    rng = random.Random(1)
    groups = {"a": [rng.gauss(0, 1) for _ in range(3000)], "b": [7.0] * 500, "c": [1e300, -1e300, 5e-324, 0.0, 2.0], "d": [float(rng.randint(1, 4)) for _ in range(2000)], "e": [3.5], "f": [10.0 ** rng.uniform(-30, 30) for _ in range(1500)], None: [1.0, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("a", NAN), ("none", None), ("none", NAN)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").fillna({"g": "null"})
    qs = [0.0, 0.02, 0.5, 0.75, 0.98, 1.0]
    got = {(r["g"], r["q"]): r["v"] for r in reduce.quantiles(df, qs, ["g"]).collect()}
    want = {(g or "null", q): float(np.quantile(vs, q)) for g, vs in groups.items() for q in qs}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12), k
    one = reduce.quantiles(df.filter("g = 'a'"), [0.25, 0.5]).collect()
    assert {r["q"]: r["v"] for r in one} == pytest.approx({0.25: np.quantile(groups["a"], 0.25), 0.5: np.median(groups["a"])})
    assert reduce.quantiles(df.filter("g = 'none'"), [0.5]).collect() == [] and reduce.quantiles(df.limit(0), [0.5], ["g"]).collect() == []
    p = reduce.percentiles(df.filter("g = 'd'"), exact=True).head()
    assert (p["p2"], p["p98"]) == (np.quantile(groups["d"], 0.02), np.quantile(groups["d"], 0.98))
    assert reduce.percentiles(df.filter("g = 'none'"), exact=True).collect() == [(None, None)]


def test_medians_of_large_groups_are_selected(spark):
    df = spark.createDataFrame([(b, i, float(i * b)) for b in (1, 2) for i in range(101)] + [(3, 0, None)], "band int, iy int, v double")
    assert {r["band"]: r["v"] for r in reduce.reduce(df, ["band"], "median").collect()} == {1: 50.0, 2: 100.0, 3: None}
    assert reduce.reduce(df, [], "median").head()[0] == float(np.median([i * b for b in (1, 2) for i in range(101)]))


@pytest.mark.parametrize("reverse", [False, True])
def test_block_mosaics_equal_numpy(spark, monkeypatch, reverse):
    rng = np.random.default_rng(5)
    layers = {}
    rows = []
    for k in range(60):
        g, chunk = int(rng.integers(0, 3)), int(rng.integers(0, 2))
        v = rng.integers(0, 100, 100).astype(float)
        v[rng.random(100) < 0.6] = np.nan
        layers.setdefault((g, chunk), []).append(v)
        rows.append((g, chunk, k, [None if x != x else x for x in v.tolist()] if k % 2 else v.tolist()))
    rows += [(0, 0, 100, None), (9, 9, 101, None), (0, 1, None, [1.0] * 100)]
    df = spark.createDataFrame(rows, "g int, chunk int, k int, data array<double>").repartition(7)
    for size in (mosaic.MERGED_BYTES, 1):  # tasks that merge all they read, and none of it
        monkeypatch.setattr(mosaic, "MERGED_BYTES", size)
        got = {(r["g"], r["chunk"]): np.array([NAN if x is None else x for x in r["data"]]) for r in mosaic.mosaic_blocks(df, ["g", "chunk"], "k", reverse=reverse).collect()}
        assert got.keys() == layers.keys()
        for k, v in layers.items():
            np.testing.assert_array_equal(got[k], mosaic.mosaic_arrays(v, reverse))
    whole = mosaic.mosaic_blocks(df.filter("g < 3"), [], "k", reverse=reverse).collect()
    assert len(whole) == 1
    floats = mosaic.mosaic_blocks(df.filter("k IS NOT NULL").withColumn("data", F.col("data").cast("array<float>")), ["g"], "k")
    assert dict(floats.dtypes)["data"] == "array<float>" and floats.count() == 3
    assert mosaic.mosaic_blocks(df.limit(0), ["g"], "k").collect() == []


def test_layers_above_win_wherever_they_are(spark):
    df = spark.range(400, numPartitions=4).select((F.col("id") % 2).alias("g"), "id", F.array_repeat(F.col("id").cast("double"), 50).alias("data"))
    out = mosaic.mosaic_blocks(df, ["g"], "id")
    assert {r["g"]: set(r["data"]) for r in out.collect()} == {0: {398.0}, 1: {399.0}}


def test_layers_are_dealt_out_before_their_blocks_are_made(spark, monkeypatch, capsys):
    """all blocks of a small file of rows were made and merged by one task."""
    monkeypatch.setattr(mosaic, "LAYERED_PIXELS", 1000, raising=False)
    catalogue.block_mosaic_256(spark, "/root/testdata/sf0.001").explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out
    few = spark.range(200, numPartitions=1).select((F.col("id") % 3).alias("g"), "id")
    dealt = mosaic.dealt_layers(few, ["g"], "id", 100)
    parts = [{r["g"] for r in p} for p in dealt.rdd.glom().collect()]
    assert len(parts) == 21 and sum(map(len, parts)) <= 21 + 3 and max(map(len, dealt.rdd.glom().collect())) < 40
    out = mosaic.mosaic_blocks(dealt.withColumn("data", F.array_repeat(F.col("id").cast("double"), 100)), ["g"], "id")
    assert {r["g"]: set(r["data"]) for r in out.collect()} == {0: {198.0}, 1: {199.0}, 2: {197.0}}
    assert mosaic.dealt_layers(few.limit(0), ["g"], "id", 100).collect() == []
