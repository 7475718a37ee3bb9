import random

import pytest

from quadrille.operators.mosaic import mosaic
from quadrille.streaming.kept import compacted, current
from quadrille.streaming.mosaic import keep_mosaic, stream_mosaic

BY = ["band", "iy", "ix"]
NAN = float("nan")


def scenes(seed):
    rng = random.Random(seed)
    out = [("A", y, x, order, rng.choice([None, NAN, rng.random()])) for order in range(12) for y in range(3) for x in range(4) if rng.random() < 0.7]
    return [*out, ("A", 9, 9, 3, None), ("B", 0, 0, 5, 2.5)]


def plain(df):
    return sorted((r["band"], r["iy"], r["ix"], r["v"]) for r in df.collect())


@pytest.mark.parametrize("reverse", [False, True])
def test_a_kept_mosaic_equals_that_of_a_batch_in_any_order_of_arrival(spark, tmp_path, reverse):
    rows = scenes(7)
    schema = "band string, iy int, ix int, ord long, v double"
    random.Random(reverse).shuffle(rows)
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    kept, state = str(tmp_path / "kept"), str(tmp_path / "state")
    assert current(spark, kept, BY) is None
    compacted(spark, kept, str(tmp_path / "no"), BY)
    third = len(rows) // 3
    for i in range(3):  # started anew each time, as after a failure
        part = rows[i * third : (i + 1) * third if i < 2 else None]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = keep_mosaic(source, kept, state, BY, "ord", reverse=reverse).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        arrived = spark.createDataFrame(rows[: (i + 1) * third if i < 2 else None], schema)
        assert plain(current(spark, kept, BY)) == plain(mosaic(arrived, BY, "ord", reverse=reverse))
    compacted(spark, kept, str(tmp_path / "small"), BY)
    assert plain(current(spark, str(tmp_path / "small"), BY)) == plain(current(spark, kept, BY))


def test_ties_and_nodata(spark):
    px = spark.createDataFrame([("A", 0, 0, 1, 5.0), ("A", 0, 0, 1, 4.0), ("A", 0, 1, 2, -1.0), ("A", 0, 1, 1, NAN)], "band string, iy int, ix int, ord long, v double")
    assert plain(stream_mosaic(px, BY, "ord").filter("ix = 0")) == [("A", 0, 0, 5.0)] and plain(stream_mosaic(px, BY, "ord", reverse=True).filter("ix = 0")) == [("A", 0, 0, 4.0)]
    assert plain(stream_mosaic(px, BY, "ord", nodata=-1.0).filter("ix = 1")) != [("A", 0, 1, -1.0)]
    with pytest.raises(ValueError):
        stream_mosaic(px.selectExpr("band", "iy", "ix", "ord", "cast(v as int) v"), BY, "ord")
