import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.functions import crs, media, metadata, values
from quadrille.functions.grid import GridSpec, snap
from quadrille.operators import mosaic, reduce, render, select, warp
from quadrille.sources import items
from quadrille.streaming import resample as streaming

NAN = float("nan")
LAYERS = [[NAN, 1.0, 2.0, NAN], [NAN, 10.0, 20.0, 30.0], [NAN, 100.0, 200.0, NAN]]


def test_mosaic_goldens(spark):
    rows = [(t, p, v) for t, layer in enumerate(LAYERS) for p, v in enumerate(layer)]
    px = spark.createDataFrame(rows, "time_idx int, p int, v double")
    for reverse, want in ((False, [None, 100, 200, 30]), (True, [None, 1, 2, 30])):
        got = {r["p"]: r["v"] for r in mosaic.mosaic(px, ["p"], "time_idx", reverse=reverse).collect()}
        assert [got[i] for i in range(4)] == want
        np.testing.assert_array_equal(mosaic.mosaic_arrays(np.array(LAYERS), reverse), [NAN if w is None else w for w in want])
    with pytest.raises(ValueError, match="Cannot use"):
        mosaic.mosaic(px.withColumn("v", F.lit(1)), ["p"], "time_idx")
    with pytest.raises(ValueError, match="Cannot use"):
        mosaic.mosaic_arrays(np.zeros((2, 2), "uint8"))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from([0, 1, 2, 3]), min_size=3, max_size=3), min_size=1, max_size=5), st.booleans(), st.sampled_from([0, 3]))
def test_mosaic_equals_numpy_with_any_nodata(spark, layers, reverse, nodata):
    rows = [(t, p, v) for t, layer in enumerate(layers) for p, v in enumerate(layer)]
    px = spark.createDataFrame(rows, "time_idx int, p int, v int").repartition(3)
    got = {r["p"]: r["v"] for r in mosaic.mosaic(px, ["p"], "time_idx", reverse=reverse, nodata=nodata).collect()}
    assert [got[i] for i in range(3)] == mosaic.mosaic_arrays(np.array(layers), reverse, nodata).tolist()


def test_crs_points_and_round_trips(spark):
    x, y = crs.transform(-79.387139, 43.642567, 4326, 32617)
    assert abs(x - 630084) < 1 and abs(y - 4833438) < 1
    x, y = crs.transform(-105.78, 35.79, 4326, 3857)
    assert (round(float(x), 4), round(float(y), 4)) == (-11775375.7361, 4271764.0367)
    lon, lat = np.meshgrid(np.linspace(-108, -102, 9), np.linspace(-79, 83, 20))
    for code in (32613, 32713, 3857):
        back = crs.transform(*crs.transform(lon, lat, 4326, code), code, 4326)
        np.testing.assert_allclose(back, (lon, lat), atol=1e-8)
    d = spark.createDataFrame([(-105.78, 35.79), (0.0, 90.0)], "lon double, lat double")
    rows = d.select(*crs.transform(F.col("lon"), F.col("lat"), 4326, 32613)).collect()
    np.testing.assert_allclose(rows[0], crs.transform(-105.78, 35.79, 4326, 32613), rtol=1e-12)
    assert rows[1][0] is None
    with pytest.raises(ValueError):
        crs.transform(0.0, 90.0, 4326, 3857)
    with pytest.raises(NotImplementedError):
        crs.transform(0.0, 0.0, 4326, 28992)
    assert [round(v, 4) for v in crs.tile_bounds(3, 2, 5)] == [-10018754.1714, -10018754.1714, -5009377.0857, -5009377.0857]


def test_bounds_goldens():
    assert snap((0, 0, 10, 10), (3, 3)) == (0, 0, 12, 12) and snap((-1.2, -1.2, 1.2, 1.2), (1, 1)) == (-2, -2, 2, 2)


def test_media_types(spark):
    d = spark.createDataFrame([("image/tiff; application=geotiff",), ("image/tiff",), ("image/jp2",), ("text",), (None,)], "t string")
    p = media.parse_type(F.col("t"))
    want = {"image/tiff": [True, True, False, False, False], "image/tiff; application=geotiff": [True, False, False, False, False], "image": [True, True, True, False, False]}
    for target, hits in want.items():
        assert [r[0] for r in d.select(media.accepts(p, target)).collect()] == hits
    with pytest.raises(Exception, match="not a media type"):
        spark.createDataFrame([("a/b/c",)], "t string").select(media.parse_type(F.col("t"))).collect()


def test_warp_linear_and_nearest_equal_numpy(spark):
    rng = np.random.default_rng(1)
    src = GridSpec(32613, (0, 0, 60, 50), (10, 10))
    data = rng.random((5, 6))
    data[2, 3] = NAN
    px = spark.createDataFrame([(0, 0, i, j, None if math.isnan(data[i, j]) else float(data[i, j])) for i in range(5) for j in range(6)], "time_idx int, band_idx int, iy int, ix int, v double")
    to = GridSpec(32613, (-5, -3, 57, 49), (4, 5))
    h, w = to.shape
    layers = px.select("time_idx", "band_idx").distinct()
    for how in ("nearest", "linear"):
        want = np.full((h, w), NAN)
        for i in range(h):
            for j in range(w):
                fx, fy = (-5 + j * 62 / w) / 10, (50 - (49 - i * 52 / h)) / 10
                if 0 <= fx <= 5 and 0 <= fy <= 4:
                    if how == "nearest":
                        want[i, j] = data[math.floor(fy + 0.5), math.ceil(fx - 0.5)]
                    else:
                        a, b = min(int(fx), 4), min(int(fy), 3)
                        u, v = fx - a, fy - b
                        want[i, j] = data[b, a] * (1 - u) * (1 - v) + data[b, a + 1] * u * (1 - v) + data[b + 1, a] * (1 - u) * v + data[b + 1, a + 1] * u * v
        got = np.full((h, w), NAN)
        for r in warp.reproject(px, src, to, layers, interpolation=how).collect():
            got[r["iy"], r["ix"]] = NAN if r["v"] is None else r["v"]
        np.testing.assert_allclose(got, want, atol=1e-12)
    flags = warp.reproject(px.withColumn("v", F.col("ix") > 2), src, to, layers).agg(F.count_if("v"), F.count("v")).head()
    assert 0 < flags[0] < flags[1]
    assert warp.xyz_tile(px, src, 0, 0, 3, layers) is None
    with pytest.raises(ValueError):
        warp.reproject(px, src, to, layers, interpolation="cubic")


def unpng(data):
    at, raw, size = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        raw += body if kind == b"IDAT" else b""
        at += 12 + n
    w, h = size
    return np.frombuffer(zlib.decompress(raw), np.uint8).reshape(h, 1 + 4 * w)[:, 1:].reshape(h, w, 4)


def test_tiles_are_png(spark):
    rows = [(i, j, float(i * 4 + j) if i != j else None) for i in range(4) for j in range(4)]
    px = spark.createDataFrame(rows, "iy int, ix int, red double").withColumn("z", F.lit(1))
    tile = unpng(render.encode_tiles(render.rgba(px, ["red"], (0, 15)), ["z"], (4, 4)).head()["png"])
    want = [[int(255 * (i * 4 + j) / 15) if i != j else 0 for j in range(4)] for i in range(4)]
    assert tile[..., 0].tolist() == want and tile[..., 2].tolist() == want
    assert tile[..., 3].tolist() == [[255 if i != j else 30 for j in range(4)] for i in range(4)]
    cmap = render.colour_table()
    coloured = unpng(render.encode_tiles(render.rgba(px, ["red"], (0, 15), cmap=cmap), ["z"], (4, 4)).head()["png"])
    assert coloured[3, 2, :3].tolist() == cmap[int(14 / 15 * 256)].tolist()
    assert unpng(render.empty_tile(16))[..., 3].tolist() == np.where(render.checkerboard((16, 16)), 30, 0).tolist()
    for args in ((0, None, None), (4, None, None), (2, None, cmap), (1, (2, 1), None)):
        with pytest.raises(ValueError):
            render.check_display(*args)


def test_display_values(spark):
    d = spark.createDataFrame([(v,) for v in (0.0, 0.5, 1.0, 1.2, -0.3, None)], "v double")
    assert [r[0] for r in d.select(values.quantise(F.col("v"))).collect()] == [0, 127, 255, 255, 0, 0]
    assert [r[0] for r in d.select(values.normalise(F.col("v"), 2, 2)).collect()] == [0] * 5 + [None]


def test_periods():
    assert [str(p)[:10] for p in select.period("2020-02")] == ["2020-02-01", "2020-03-01"]
    assert [str(p)[:10] for p in select.period("2019")] == ["2019-01-01", "2020-01-01"]


def test_weeks_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    from quadrille.plans.views import pixels

    px = pixels(spark, "/root/testdata/sf0.001").select("t", "band", "v")
    px.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(px.schema).parquet(str(tmp_path / "in"))
    q = streaming.weekly(source, ["band"]).writeStream.format("memory").queryName("weeks").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted((str(r["bucket"]), r["band"], round(r["v"], 9) if r["v"] is not None else None) for r in d.collect())
    assert key(spark.table("weeks")) == key(reduce.resample(px, "1w", "mean", ["band"])) == key(streaming.weekly(px, ["band"]))


def test_metadata_values():
    assert metadata.canonical(1.0) == metadata.canonical(1) == metadata.canonical(True) and metadata.canonical({"b": 1, "a": 2}) == '{"a": 2, "b": 1}'
    assert metadata.flat([["x"]]) == "x" and metadata.flat(["b", "a", "b"]) == ("a", "b")
    assert metadata.flat({"a": 1}) is None and metadata.flat([[1, 2], [3, 4]]) is None and metadata.flat([]) is None


class Item:
    def __init__(self, i):
        self.i = i

    def to_dict(self):
        return {"id": self.i}


class Catalogue:
    def get_all_items(self):
        return iter([Item("a"), Item("b")])


def test_item_adapters():
    class Old:
        _data = {"id": "old"}

    assert items.to_plain({"id": "foo"}) == [{"id": "foo"}]
    assert items.to_plain([{"id": "foo"}, Item("x"), Old()]) == [{"id": "foo"}, {"id": "x"}, {"id": "old"}]
    assert items.to_plain(Catalogue()) == [{"id": "a"}, {"id": "b"}] and items.to_plain(Item("y")) == [{"id": "y"}]
    assert items.to_plain({"type": "FeatureCollection", "features": [{"id": "q"}]}) == [{"id": "q"}]
    for bad in ("text", 3, [4]):
        with pytest.raises(TypeError, match="no item|holds no items"):
            items.to_plain(bad)
