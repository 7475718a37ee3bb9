import struct
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quadrille.functions import crs
from quadrille.functions.grid import GridSpec
from quadrille.plans import chunks
from quadrille.plans.planner import plan
from quadrille.plans.stack import stack
from quadrille.sources import env, readers


def item(i, date, x0, y0, value, n=10, res=10.0, epsg=32613, shift=0, **more):
    box = [x0, y0, x0 + n * res, y0 + n * res]
    lonlat = crs.reproject_bounds(box, epsg, 4326)
    asset = lambda v, t: {"href": f"const://{n}/{n}/{v}", "type": t}
    props = {"datetime": date, "proj:epsg": epsg, "proj:shape": [n, n], "proj:transform": [res, 0, x0, 0, -res, y0 + n * res], "proj:bbox": box, "eo:cloud_cover": i * 10, **more}
    return {"id": f"i{i}", "bbox": list(lonlat), "properties": props, "assets": {"red": asset(value, "image/tiff; application=geotiff") | {"eo:bands": [{"common_name": "red", "center_wavelength": 0.6}]}, "nir": asset(value * 2, "image/jp2"), "meta": {"href": "x", "type": "application/json"}}}


ITEMS = [item(0, "2020-01-05T12:00:00Z", 400000, 3900000, 1.0), item(1, "2020-01-01T00:00:00Z", 400050, 3900000, 2.0), item(2, "2020-01-20T00:00:00+02:00", 400000, 3900050, 3.0)]


def test_stack_equals_a_numpy_model(spark):
    s = stack(spark, ITEMS)
    assert s.spec.bounds == (400000, 3900000, 400150, 3900150) and s.spec.resolutions_xy == (10, 10)
    assert s.shape == (3, 2, 15, 15) and [r["band"] for r in s.band_dim.orderBy("band_idx").collect()] == ["red", "nir"]
    want = np.full((3, 2, 15, 15), np.nan)
    for t, (v, iy, ix) in enumerate([(2.0, 5, 5), (1.0, 5, 0), (3.0, 0, 0)]):
        want[t, :, iy : iy + 10, ix : ix + 10] = np.array([v, 2 * v])[:, None, None]
    got = np.full_like(want, np.nan)
    for r in s.pixels.collect():
        got[r["time_idx"], r["band_idx"], r["iy"], r["ix"]] = r["v"]
    np.testing.assert_array_equal(got, want)
    assert s.dense().count() == want.size
    times = [(str(r["time"]), r["id"], r["eo:cloud_cover"]) for r in s.time_dim.orderBy("time_idx").collect()]
    assert times == [("2020-01-01 00:00:00", "i1", 10), ("2020-01-05 12:00:00", "i0", 0), ("2020-01-19 22:00:00", "i2", 20)]
    assert dict(s.time_dim.dtypes)["eo:cloud_cover"] == "bigint" and s.time_dim.filter("`eo:cloud_cover` < 15").count() == 2
    red = s.band_dim.filter("band = 'red'").head()
    assert red["common_name"] == "red" and red["center_wavelength"] == 0.6 and red["epsg"] == 32613
    top = {(r["band_idx"], r["iy"], r["ix"]): r["v"] for r in s.mosaic().collect()}
    first = {(r["band_idx"], r["iy"], r["ix"]): r["v"] for r in s.mosaic(reverse=True).collect()}
    assert top[0, 5, 5] == 3.0 and first[0, 5, 5] == 2.0 and top[1, 14, 14] == 4.0
    assert {r["v"] for r in s.ratio("nir", "red").collect()} == {2 / 6 * 1.0}
    clear = s.sel(band="red", where=s.time_dim["eo:cloud_cover"].cast("int") < 15)
    assert clear.pixels.count() == 200
    assert s.sel(time=("2020-01-02", "2020-01-05")).pixels.count() == 200
    cut = s.box(x=(400020, 400060), y=(3900080, 3900040))
    assert cut.spec.bounds == (400020, 3900030, 400070, 3900080) and cut.pixels.agg({"iy": "max"}).head()[0] == 4
    weeks = s.resample("1w", "mean", by=["band"], gaps=True).orderBy("bucket", "band").collect()
    assert [str(r["bucket"])[:10] for r in weeks] == ["2020-01-05"] * 2 + ["2020-01-12"] * 2 + ["2020-01-19"] * 2 and weeks[2]["v"] is None
    assert s.reduce("mean", ("time", "y", "x")).count() == 2


def test_planning_opens_nothing_and_each_raster_is_opened_once(spark, tmp_path):
    log = str(tmp_path)

    def reader(url, options):
        import os
        import uuid

        with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
            f.write(url)
        return readers.constant(url, options)

    items = [item(i, f"2020-01-0{i + 1}T00:00:00Z", 400000, 3900000, 1.0 + 10 * i) for i in range(3)]
    s = stack(spark, items, reader=reader, chunksize=4)
    assert list(tmp_path.iterdir()) == []
    assert s.pixels.count() == 600
    urls = [p.read_text() for p in tmp_path.iterdir()]
    assert len(urls) == len(set(urls)) == 6


def counting(log):
    def reader(url, options):
        import os
        import uuid

        with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
            f.write(url)
        return readers.constant(url, options)

    return reader


def test_selections_open_only_what_they_need(spark, tmp_path):
    items = [item(i, f"2020-01-{i + 1:02}T00:00:00Z", 400000 + 200 * (i % 5), 3900000 + 200 * (i // 5), 1.0 + i) for i in range(20)]
    opened = lambda d: sorted(p.read_text() for p in d.iterdir())

    def run(name, pick):
        (d := tmp_path / name).mkdir()
        got = pick(stack(spark, items, reader=counting(str(d)), chunksize=64)).pixels
        return {(r["time_idx"], r["band_idx"], r["iy"], r["ix"]): r["v"] for r in got.collect()}, opened(d)

    rows, urls = run("box", lambda s: s.sel(band="red").box(x=(400210, 400250), y=(3900290, 3900240)))
    assert urls == ["const://10/10/7.0"] and rows == {(6, 0, k, i): 7.0 for k in range(6) for i in range(5)}
    rows, urls = run("day", lambda s: s.sel(time=("2020-01-04", "2020-01-04")))
    assert urls == ["const://10/10/4.0", "const://10/10/8.0"] and len(rows) == 200
    rows, urls = run("clear", lambda s: s.sel(band="nir", where="CAST(`eo:cloud_cover` AS INT) BETWEEN 20 AND 30"))
    assert urls == ["const://10/10/6.0", "const://10/10/8.0"] and len(rows) == 200
    rows, urls = run("twice", lambda s: s.box(x=(400000, 400390), y=(3900390, 3900000)).sel(band=["red"]).box(x=(400200, 400290), y=(3900090, 3900000)))
    assert urls == ["const://10/10/2.0"] and {k[2:] for k in rows} == {(k, i) for k in range(9) for i in range(10)}
    rows, urls = run("none", lambda s: s.sel(where="CAST(`eo:cloud_cover` AS INT) > 900"))
    assert urls == [] and rows == {}


def test_planning_compiles(spark):
    items = [item(0, "2020-01-01T00:00:00Z", 400000, 3900000, 1.0), item(1, "2020-01-02T00:00:00Z", 500000, 4000000, 1.0, epsg=32614)]
    for k, v in (only := {"spark.sql.codegen.fallback": "false", "spark.sql.codegen.factoryMode": "CODEGEN_ONLY"}).items():
        spark.conf.set(k, v)
    try:
        p = plan(spark, items, epsg=3857, resolution=100)
        assert p.cells.count() == 4 and p.n_times == 2
        assert stack(spark, items, epsg=32613).pixels.count() > 0
    finally:
        for k in only:
            spark.conf.unset(k)


def test_what_no_reader_reads_is_refused_when_planning(spark):
    items = change(lambda i: i[1]["assets"]["nir"].update({"href": "s3://x/B08.JP2?sig=1"}))
    with pytest.raises(NotImplementedError, match="JPEG 2000"):
        stack(spark, items)
    assert stack(spark, items, reader=readers.constant).shape == (3, 2, 15, 15)
    with pytest.raises(NotImplementedError, match="gauss"):
        stack(spark, ITEMS, resampling="gauss")


def test_bounds_drop_assets_but_not_their_resolution(spark):
    far = item(3, "2020-02-01T00:00:00Z", 500000, 3900000, 9.0, n=10, res=5.0)
    s = stack(spark, [*ITEMS, far], bounds=(400000, 3900000, 400100, 3900100))
    assert s.spec.resolutions_xy == (5, 5) and s.shape == (3, 2, 20, 20)
    none = stack(spark, ITEMS, bounds=(0, 0, 100, 100))
    assert none.shape == (0, 0, 10, 10) and none.pixels.count() == 0
    lon = crs.reproject_bounds((400000, 3900000, 400150, 3900150), 32613, 4326)
    assert stack(spark, ITEMS, bounds_latlon=lon).spec.epsg == 32613


def test_other_crs_scale_and_missing_data(spark):
    scaled = item(0, "2020-01-05T12:00:00Z", 400000, 3900000, 4.0)
    scaled["assets"]["red"]["raster:bands"] = [{"scale": 0.5, "offset": 1}]
    s = stack(spark, [scaled], assets=["red"], epsg=3857, resolution=20)
    assert s.spec.epsg == 3857 and {r["v"] for r in s.pixels.collect()} == {3.0}
    assert {r["v"] for r in stack(spark, [scaled], assets=["red"], rescale=False).pixels.collect()} == {4.0}

    def broken(url, options):
        raise OSError("HTTP response code: 404")

    assert stack(spark, ITEMS, reader=broken).pixels.count() == 0
    with pytest.raises(Exception, match="Error opening"):
        stack(spark, ITEMS, reader=broken, errors_as_nodata=()).pixels.count()


def change(f):
    import copy

    items = copy.deepcopy(ITEMS)
    f(items)
    return items


def drop(*keys):
    def f(items):
        for k in keys:
            items[1]["properties"].pop(k, None)
            items[1].pop(k, None)

    return f


@pytest.mark.parametrize(
    "items, kw, error, text",
    [
        (ITEMS, {"bounds": (0, 0, 1, 1), "bounds_latlon": (0, 0, 1, 1)}, ValueError, "both"),
        ([], {}, ValueError, "No items"),
        (ITEMS, {"assets": []}, ValueError, "Zero"),
        (ITEMS, {"assets": ["nope"]}, AssertionError, "nothing is known"),
        (change(drop("proj:epsg")), {}, ValueError, "names no CRS"),
        (change(lambda i: i[2]["properties"].update({"proj:epsg": 32614})), {}, ValueError, "EPSG:32614"),
        (change(lambda i: i[1]["assets"]["red"].update({"raster:bands": [{}, {}]})), {}, ValueError, "raster:bands"),
        (change(lambda i: i[1]["properties"].update({"proj:transform": [10, 1, 0, 1, -10, 0]})), {}, NotImplementedError, "axis"),
        (change(drop("proj:transform", "proj:shape")), {}, ValueError, "resolution"),
        (change(drop("proj:transform", "proj:shape", "proj:bbox", "bbox")), {"resolution": 10}, ValueError, "bounds"),
        (ITEMS, {"xy_coords": "middle"}, ValueError, "xy_coords"),
        (ITEMS, {"dtype": "uint8", "fill_value": -1}, ValueError, "fill_value"),
        (ITEMS, {"dtype": "int16", "fill_value": 0.5}, ValueError, "fill_value"),
    ],
)
def test_errors(spark, items, kw, error, text):
    with pytest.raises(error, match=text):
        stack(spark, items, **kw)


def test_asset_selection(spark):
    odd = change(lambda i: (i[1]["assets"].pop("nir"), i[2]["assets"].update({"b": {"href": "const://1/1/1"}, "a": {"href": "const://1/1/1"}})))
    assert plan(spark, odd, assets=None).bands == ["red", "nir", "meta", "b", "a"]
    assert plan(spark, odd, assets=["nir", "red", "zzz"]).bands == ["nir", "red"]
    with pytest.warns(UserWarning, match="without a type"):
        assert plan(spark, odd).bands == ["red", "nir"]
    assert plan(spark, odd, assets={"application/json"}).bands == ["meta"]


def tiff(data, tiled=False, deflate=True, predictor=False, epsg=32613, nodata=None, endian="<", big=False, pack=None):
    """A minimal writer for the reader's subset."""
    h, w = data.shape
    th, tw = (16, 16) if tiled else (3, w)
    parts = []
    for y in range(0, h, th):
        for x in range(0, w, tw) if tiled else [0]:
            block = data[y : y + th, x : x + tw]
            if tiled:
                block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1])))
            if predictor and data.dtype.kind == "f":  # bytes by place, highest first, then differences
                planes = np.ascontiguousarray(block.astype(data.dtype.newbyteorder(">"))).view(np.uint8).reshape(len(block), -1, data.dtype.itemsize).transpose(0, 2, 1).reshape(len(block), -1)
                raw = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], 1).tobytes()
                parts.append(zlib.compress(raw))
                continue
            if predictor:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], 1).astype(data.dtype)
            raw = block.astype(data.dtype.newbyteorder(endian)).tobytes()
            parts.append(pack[1](raw) if pack else zlib.compress(raw) if deflate else raw)
    offs, at = [], 16 if big else 8
    for p in parts:
        offs.append(at)
        at += len(p)
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [data.dtype.itemsize * 8]), 259: ("H", [pack[0] if pack else 8 if deflate else 1]), 277: ("H", [1]), 339: ("H", [kind]), 317: ("H", [(3 if data.dtype.kind == "f" else 2) if predictor else 1]), 33550: ("d", [10.0, 10.0, 0.0]), 33922: ("d", [0.0, 0, 0, 400000.0, 3900100.0, 0]), 34735: ("H", [1, 1, 0, 1, 3072, 0, 1, epsg])}
    tags |= {322: ("I", [tw]), 323: ("I", [th]), 324: ("I", offs), 325: ("I", [len(p) for p in parts])} if tiled else {278: ("I", [th]), 273: ("I", offs), 279: ("I", [len(p) for p in parts])}
    if nodata is not None:
        tags[42113] = ("s", str(nodata).encode() + b"\0")
    code = {"H": 3, "I": 4, "d": 12, "s": 2}
    word, count, room = ("Q", "Q", 8) if big else ("I", "H", 4)
    extra_at = at + struct.calcsize(count) + (8 + 2 * room - 4) * len(tags) + room
    ifd, extra = struct.pack(endian + count, len(tags)), b""
    for tag in sorted(tags):
        c, v = tags[tag]
        raw = v if c == "s" else struct.pack(f"{endian}{len(v)}{c}", *v)
        n = len(v)
        field = raw.ljust(room, b"\0") if len(raw) <= room else struct.pack(endian + word, extra_at + len(extra))
        extra += raw if len(raw) > room else b""
        ifd += struct.pack(endian + "HH" + word, tag, code[c], n) + field
    head = {"<": b"II", ">": b"MM"}[endian] + (struct.pack(endian + "HHHQ", 43, 8, 0, at) if big else struct.pack(endian + "HI", 42, at))
    return head + b"".join(parts) + ifd + struct.pack(endian + word, 0) + extra


def lzw(data):
    """What readers.lzw undoes, made from the other end: longest known runs, codes that widen one entry early."""
    bits, table, width, run = "", {}, 9, b""
    for i in range(256):
        table[bytes([i])] = i
    bits += f"{256:09b}"
    free = 258
    for b in data:
        more = run + bytes([b])
        if more in table:
            run = more
            continue
        bits += f"{table[run]:0{width}b}"
        table[more] = free
        free += 1
        width += free == 1 << width
        run = bytes([b])
        if free == 4095:
            bits += f"{table[run]:0{width}b}{256:0{width}b}"
            table, width, free, run = {bytes([i]): i for i in range(256)}, 9, 258, b""
    if run:
        bits += f"{table[run]:0{width}b}"
        width += free + 1 == 1 << width
    bits += f"{257:0{width}b}"
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def zstd(data):
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


def test_lzw_round_trips():
    rng = np.random.default_rng(1)
    for data in (b"", b"a", b"aaaaaaa", bytes(rng.integers(0, 256, 30_000, dtype=np.uint8)), bytes(rng.integers(0, 4, 60_000, dtype=np.uint8)), b"abcabcabc" * 5000):
        assert readers.lzw(lzw(data)) == data


@pytest.mark.parametrize("kw", [{}, {"tiled": True}, {"predictor": True}, {"deflate": False}, {"endian": ">"}, {"tiled": True, "predictor": True, "endian": ">"}, {"big": True}, {"big": True, "endian": ">", "tiled": True}, {"pack": (5, lzw)}, {"pack": (50000, zstd), "tiled": True}])
@pytest.mark.parametrize("dtype", ["uint8", "int16", "float32"])
def test_geotiff_subset(tmp_path, kw, dtype):
    data = (np.arange(20 * 23).reshape(20, 23) % 200).astype(dtype)
    path = tmp_path / "a.tif"
    path.write_bytes(tiff(data, nodata=7, **kw))
    r = readers.pick(str(path), {})
    np.testing.assert_array_equal(r.data, data)
    assert r.epsg == 32613 and r.transform == (10.0, 0.0, 400000.0, 0.0, -10.0, 3900100.0) and np.isnan(r.values).sum() == (data == 7).sum()


def test_stack_reads_files(spark, tmp_path):
    data = np.arange(100, dtype="int16").reshape(10, 10)
    (tmp_path / "a.tif").write_bytes(tiff(data, nodata=0))
    np.save(tmp_path / "b.npy", data.astype("float32"))
    it = item(0, "2020-01-05T12:00:00Z", 400000, 3900000, 1.0)
    it["assets"]["red"]["href"], it["assets"]["nir"]["href"] = f"file://{tmp_path}/a.tif", f"{tmp_path}/b.npy"
    s = stack(spark, [it], chunksize=(3, 4), gdal_env={"nodata": 99})
    got = np.full((2, 10, 10), np.nan)
    for r in s.pixels.collect():
        got[r["band_idx"], r["iy"], r["ix"]] = r["v"]
    want = np.stack([np.where(data == 0, np.nan, data), np.where(data == 99, np.nan, data)])
    np.testing.assert_array_equal(got, want)
    fine = stack(spark, [it], assets=["nir"], resolution=5, resampling="bilinear", gdal_env={"nodata": -1})
    v = {(r["iy"], r["ix"]): r["v"] for r in fine.pixels.collect()}
    assert len(v) == 400 and v[1, 1] == pytest.approx(0.25 * 0.75 * 1 + 0.25 * 0.75 * 10 + 0.25 * 0.25 * 11)


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.tuples(*[st.integers(0, 12)] * 4), st.one_of(st.integers(1, 10), st.just(-1), st.just("auto"), st.just("1KB"), st.tuples(st.integers(1, 5), st.integers(1, 5)), st.dictionaries(st.integers(0, 3), st.integers(1, 5)), st.tuples(*[st.integers(1, 5)] * 4)))
def test_chunks_cover_the_shape(shape, c):
    got = chunks.normalize(c, shape)
    assert tuple(map(sum, got)) == shape and all(n >= 0 for d in got for n in d)
    if isinstance(c, int) and c > 0:
        assert all(n <= 1 for d in got[:2] for n in d) and all(n <= c for d in got[2:] for n in d)


def test_layered_options_and_error_patterns():
    e = env.LayeredOptions({"a": 1}, {"b": 2}, {}, {"c": 3})
    assert e.for_open_vrt() == {"a": 1, "b": 2} and e.for_read() == {"a": 1, "c": 3}
    assert e.updated(open_vrt={"d": 4}).for_open_vrt() == {"a": 1, "d": 4}
    p = [OSError("HTTP response code: 404")]
    assert env.matches(OSError("HTTP response code: 404!"), p) and not env.matches(OSError("x HTTP response code: 404"), p)
    assert not env.matches(ValueError("HTTP response code: 404"), p)


def test_grid_goldens():
    g = lambda b, r: GridSpec(32613, b, r)
    assert g((0, 0, 10, 10), (3, 3)).shape == (3, 3) and g((0, 0, 10, 11), (4, 4)).shape == (3, 3)
    assert g((399960, 3890220, 509760, 4000020), (10, 10)).shape == (10980, 10980)
    for b, r in [((0, 0, 1, 1), (3, 3)), ((1, 0, 0, 1), (1, 1)), ((0, 0, 1, 1), (0, 1))]:
        with pytest.raises(AssertionError):
            g(b, r)
    assert g((0, 0, 10, 10), (5, 5)).attrs()["resolution"] == 5 and "resolution_xy" in g((0, 0, 10, 10), (5, 2)).attrs()


def test_resamplings_of_a_block():
    from quadrille.plans.stack import RESAMPLINGS, warp_block
    from quadrille.sources.readers import Raster

    rng = np.random.default_rng(3)
    data = rng.integers(0, 5, (12, 18)).astype(float)
    data[0:3, 0:3] = np.nan
    data[4, 4] = np.nan
    spec = GridSpec(32613, (0.0, 0.0, 18.0, 12.0), (3.0, 3.0))
    iy, ix = (v.ravel() for v in np.mgrid[0:4, 0:6])
    got = {r: warp_block(Raster(data), spec, iy, ix, (0.0, 0.0, 18.0, 12.0), r) for r in RESAMPLINGS}
    for k, (y, x) in enumerate(zip(iy, ix, strict=True)):
        part = data[3 * y : 3 * y + 3, 3 * x : 3 * x + 3]
        some = part[~np.isnan(part)]
        if not len(some):
            assert all(np.isnan(v[k]) for r, v in got.items() if r not in ("bilinear", "cubic"))
            continue
        n = np.bincount(some.astype(int))
        want = {"average": some.mean(), "sum": some.sum(), "min": some.min(), "max": some.max(), "med": np.median(some), "q1": np.quantile(some, 0.25), "q3": np.quantile(some, 0.75), "mode": n.argmax()}
        assert all(np.isclose(got[r][k], v) for r, v in want.items())
        assert np.isclose(got["nearest"][k], part[1, 1], equal_nan=True) and (np.isnan(part[1, 1]) or np.isclose(got["bilinear"][k], part[1, 1]))
    flat = warp_block(Raster(np.add.outer(np.arange(12.0) * 2, np.arange(18.0))), GridSpec(32613, (4.0, 4.0, 14.0, 8.0), (0.5, 0.5)), *(v.ravel() for v in np.mgrid[0:8, 0:20]), (0.0, 0.0, 18.0, 12.0), "cubic")
    yy, xx = (v.ravel() for v in np.mgrid[0:8, 0:20])
    assert np.allclose(flat, (4 + (yy + 0.5) * 0.5 - 0.5) * 2 + 4 + (xx + 0.5) * 0.5 - 0.5)  # a plane stays one
    with pytest.raises(NotImplementedError):
        warp_block(Raster(data), spec, iy, ix, (0.0, 0.0, 18.0, 12.0), "gauss")


def test_cells_of_a_small_raster_are_looked_up_together_as_one_by_one(spark, tmp_path, monkeypatch):
    """F1 to F5: a call a cell took most of the time of a scan."""
    rng = np.random.default_rng(4)
    items = [item(i, "2020-01-01T00:00:00Z", 400000 + 10 * float(rng.integers(0, 30)), 3900000 + 5 * float(rng.integers(0, 60)), float(i % 3), n=4) for i in range(60)]
    for i in items:
        del i["properties"]["proj:transform"], i["properties"]["proj:shape"]

    def cells(log):
        class Counted(readers.Raster):
            def block(self, *window):
                with open(log, "a") as f:
                    f.write("x")
                return super().block(*window)

        opened = lambda url, options: Counted(readers.constant(url, options).data)
        rows = sorted(tuple(r) for r in stack(spark, items, resolution=5, chunksize=7, reader=opened).pixels.collect())
        return rows, len(open(log).read())

    together, n = cells(str(tmp_path / "together"))
    monkeypatch.setattr("quadrille.plans.stack.SMALL", 0)  # goes to the tasks with the functions that refer to it
    one_by_one, n_one_by_one = cells(str(tmp_path / "one"))
    assert together == one_by_one and len(together) == 60 * 2 * 64 and n < 40 and n_one_by_one >= 120


def test_partitions_of_a_ratio_grow_with_the_pixels(spark, monkeypatch):
    """Spark joined them by their compressed size, and a task held all groups of what was joined."""
    monkeypatch.setattr("quadrille.plans.stack.PIXELS", 50)
    s = stack(spark, ITEMS)
    assert s.source.parts() == 600 // 50 + 1 and s.box(x=(400000, 400040), y=(3900140, 3900100)).source.parts() < 6
    wide = s.ratio("nir", "red")
    assert wide.rdd.getNumPartitions() == 13 and {r["v"] for r in wide.collect()} == {2 / 6}
