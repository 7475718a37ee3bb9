import glob

import pytest
from pyspark.sql import functions as F

from quadrille.functions.grid import GridSpec
from quadrille.operators import show, warp

SPEC = GridSpec(32613, (400000.0, 3900000.0, 400640.0, 3900480.0), (10.0, 10.0))


@pytest.fixture(scope="module")
def wide(spark):
    p = spark.range(64 * 48).select((F.col("id") % 48).cast("int").alias("iy"), (F.col("id") / 48).cast("int").alias("ix"))
    return p.filter("iy + ix <> 20").select("iy", "ix", (F.col("iy") * 2.0 + F.col("ix")).alias("red"), (F.col("iy") * 3.0).alias("nir")).cache()


@pytest.mark.parametrize("how", ["nearest", "linear"])
def test_tiles_of_a_layer_equal_single_tiles(spark, wide, how):
    layer = show.Map().add(wide, ["red", "nir"], SPEC, vrange=(0, 100), tilesize=32, interpolation=how)
    zoom = 15
    tiles = show.tiles_of_bounds(spark.range(1), [F.lit(v) for v in layer.box()], zoom)
    got = show.tile_pixels(layer.wide, ["red"], SPEC, tiles, how, 32).collect()
    found = {(r["x"], r["y"]) for r in tiles.collect()}
    assert found and {(r["x"], r["y"]) for r in got} == found and len(got) == len(found) * 32 * 32
    px = wide.select(F.lit(0).alias("time_idx"), F.lit(0).alias("band_idx"), "iy", "ix", F.col("red").alias("v"))
    layers = spark.createDataFrame([(0, 0)], "time_idx int, band_idx int")
    for x, y in found:
        one = warp.xyz_tile(px, SPEC, x, y, zoom, layers, interpolation=how, tilesize=32)
        want = {(r["iy"], r["ix"]): r["v"] for r in one.collect()} if one is not None else {}
        mine = {(r["iy"], r["ix"]): r["red"] for r in got if (r["x"], r["y"]) == (x, y)}
        assert all(v is None and want.get(k) is None or v == pytest.approx(want[k]) for k, v in mine.items())


def test_map_and_files(wide, tmp_path):
    m = show.Map()
    layer = m.add(wide, "red", SPEC, "ndvi", tilesize=64)
    assert m.layers["ndvi"] is layer and len(layer.cmap) == 256 and 0 < layer.vrange[0] < layer.vrange[1] < 160
    assert m.add(wide, "red", SPEC, "ndvi", vrange=(0, 1)).token != layer.token and len(m.layers) == 1
    assert layer.zoom() == 17  # 40,075,017 m * cos(35.2) * 800 / (256 * 784 m) is 2 ** 16.99
    done = {r["z"]: (r["tiles"], r["bytes"]) for r in layer.write(tmp_path.as_uri(), [12, 14]).collect()}
    files = glob.glob(f"{tmp_path}/{layer.token}/*/*/*.png")
    assert set(done) == {12, 14} and len(files) == sum(n for n, _ in done.values())
    assert all(open(f, "rb").read(4) == b"\x89PNG" for f in files)
    for bad in ({"names": []}, {"names": ["red", "nir", "red", "nir"]}, {"names": ["red", "nir"], "cmap": [(0, 0, 0)]}, {"names": ["red"], "vrange": (2, 1)}):
        with pytest.raises(ValueError):
            m.add(wide, spec=SPEC, **bad)
    with pytest.raises(ValueError):
        m.add(wide.limit(0), ["red"], SPEC)
