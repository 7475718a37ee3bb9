import struct
import zlib

import numpy as np
import pytest

from quadrille.functions.grid import GridSpec
from quadrille.plans.stack import warp_block
from quadrille.sources import readers


def pyramid(path, levels, side=256, samples=(), nodata=None):
    """Tiled, deflated planes of levels of a raster, the first one with a transform; samples: what extra ones mean."""
    out, spans = bytearray(struct.pack("<2sHI", b"II", 42, 0)), []
    for planes in levels:
        part = []
        for data in planes:
            h, w = data.shape
            for y in range(0, h, side):
                for x in range(0, w, side):
                    block = data[y : y + side, x : x + side]
                    raw = zlib.compress(np.pad(block, ((0, side - block.shape[0]), (0, side - block.shape[1]))).tobytes())
                    part.append((len(out), len(raw)))
                    out += raw
        spans.append(part)
    link = 4
    for k, (planes, part) in enumerate(zip(levels, spans, strict=True)):
        h, w = planes[0].shape
        kind = planes[0].dtype
        tags = {254: ("I", [int(k > 0)]), 256: ("I", [w]), 257: ("I", [h]), 258: ("H", [kind.itemsize * 8] * len(planes)), 259: ("H", [8]), 277: ("H", [len(planes)]), 284: ("H", [2]), 322: ("I", [side]), 323: ("I", [side]), 324: ("I", [a for a, _ in part]), 325: ("I", [n for _, n in part]), 339: ("H", [{"u": 1, "i": 2, "f": 3}[kind.kind]] * len(planes))}
        if samples:
            tags[338] = ("H", list(samples))
        if not k:
            tags |= {33550: ("d", [10.0, 10.0, 0.0]), 33922: ("d", [0.0, 0, 0, 400000.0, 3950000.0, 0]), 34735: ("H", [1, 1, 0, 1, 3072, 0, 1, 32613])}
            if nodata is not None:
                tags[42113] = ("s", str(nodata).encode() + b"\0")
        entries = b""
        for tag in sorted(tags):
            c, v = tags[tag]
            raw = v if c == "s" else struct.pack(f"<{len(v)}{c}", *v)
            if len(raw) > 4:
                at, out = len(out), out + raw
                raw = struct.pack("<I", at)
            entries += struct.pack("<HHI", tag, {"H": 3, "I": 4, "d": 12, "s": 2}[c], len(v)) + raw.ljust(4, b"\0")
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0" * 4
    path.write_bytes(out)
    return len(out)


def test_a_window_reads_few_bytes_and_the_same_values(tmp_path):
    data = np.random.default_rng(1).integers(0, 60_000, (4096, 4096)).astype(np.uint16)
    size = pyramid(tmp_path / "a.tif", [[data]], nodata=7)
    for y, x in ((0, 0), (1024, 2048), (3840, 3840), (1000, 2000)):
        t = readers.geotiff(str(tmp_path / "a.tif"), {})
        want = np.where(data == 7, np.nan, data)[y : y + 256, x : x + 256]
        np.testing.assert_array_equal(t.block(y, y + 256, x, x + 256), want)
        assert t.src.bytes_read < size * 0.02 * (1 if y % 256 == 0 else 2)
    np.testing.assert_array_equal(t.data, data)
    before = t.src.bytes_read
    t = readers.geotiff(str(tmp_path / "a.tif"), {})
    t.block(100, 200, 100, 200)
    once = t.src.bytes_read
    t.block(120, 250, 90, 180)  # the same tile
    assert t.src.bytes_read == once < before


def test_the_coarsest_level_that_is_fine_enough_is_read(tmp_path):
    base = np.random.default_rng(2).integers(0, 200, (1024, 1024)).astype(np.float32)
    half, quarter = base[::2, ::2] + 1000, base[::4, ::4] + 2000
    size = pyramid(tmp_path / "o.tif", [[base], [half], [quarter]], side=128)
    t = readers.geotiff(str(tmp_path / "o.tif"), {})
    assert [t.at(s).width for s in (0.5, 1, 1.9, 2, 3.9, 4, 50)] == [1024, 1024, 1024, 512, 512, 256, 256]
    assert t.at(4).transform == (40.0, 0.0, 400000.0, 0.0, -40.0, 3950000.0)
    iy, ix = (v.ravel() for v in np.mgrid[0:256, 0:256])
    box = (400000.0, 3950000.0 - 10240, 410240.0, 3950000.0)
    got = warp_block(t, GridSpec(32613, box, (40.0, 40.0)), iy, ix, box, "nearest")
    np.testing.assert_array_equal(got.reshape(256, 256), quarter)
    assert t.src.bytes_read < size * 0.1
    full = readers.geotiff(str(tmp_path / "o.tif"), {"overviews": False})
    got = warp_block(full, GridSpec(32613, box, (40.0, 40.0)), iy, ix, box, "average")
    np.testing.assert_allclose(got.reshape(256, 256), base.reshape(256, 4, 256, 4).mean((1, 3)), rtol=1e-6)
    np.testing.assert_array_equal(full.values, base)


@pytest.mark.parametrize("resampling", ["nearest", "bilinear", "cubic", "average", "max"])
def test_windows_give_what_the_whole_raster_gives(tmp_path, resampling):
    data = np.random.default_rng(3).integers(0, 200, (300, 280)).astype(np.uint8)
    pyramid(tmp_path / "w.tif", [[data]], side=64, nodata=3)
    t = readers.geotiff(str(tmp_path / "w.tif"), {})
    whole = readers.Raster(t.data, t.epsg, t.transform, t.nodata)
    spec = GridSpec(32613, (400100.0, 3948000.0, 402000.0, 3949900.0), (25.0, 25.0))
    iy, ix = (v.ravel() for v in np.mgrid[0:76, 0:76])
    want = warp_block(whole, spec, iy, ix, spec.bounds, resampling).reshape(76, 76)
    for y in range(0, 76, 19):
        for x in range(0, 76, 38):
            part = np.s_[y : y + 19, x : x + 38]
            a, b = (v[part].ravel() for v in (iy.reshape(76, 76), ix.reshape(76, 76)))
            np.testing.assert_array_equal(warp_block(t, spec, a, b, spec.bounds, resampling).reshape(19, 38), want[part])


def test_alpha_is_told_by_its_tag(tmp_path):
    data, alpha = np.full((64, 64), 5, np.uint8), np.zeros((64, 64), np.uint8)
    alpha[:10] = 255
    for kind in (1, 2):
        pyramid(tmp_path / "a.tif", [[data, alpha]], side=64, samples=[kind])
        v = readers.geotiff(str(tmp_path / "a.tif"), {}).values
        assert (v[:10] == 5).all() and np.isnan(v[10:]).all()
    pyramid(tmp_path / "b.tif", [[data, alpha]], side=64, samples=[0])
    with pytest.raises(RuntimeError, match="single band"):
        readers.geotiff(str(tmp_path / "b.tif"), {})


def test_npy_files_are_read_by_rows(tmp_path):
    data = np.arange(2000 * 1000, dtype="float32").reshape(2000, 1000)
    for name, a in (("c", data), ("f", np.asfortranarray(data))):
        np.save(tmp_path / f"{name}.npy", a)
        for window in ((10, 20, 0, 1000), (5, 300, 900, 950), (0, 2000, 0, 1000), (1999, 2000, 999, 1000)):
            t = readers.npy(str(tmp_path / f"{name}.npy"), {"nodata": 10_005})
            y0, y1, x0, x1 = window
            want = np.where(data == 10_005, np.nan, data)[y0:y1, x0:x1]
            np.testing.assert_array_equal(t.block(*window), want)
        assert t.src.bytes_read < 100_000
    np.save(tmp_path / "d.npy", np.zeros((2, 3, 4)))
    with pytest.raises(RuntimeError, match="single band"):
        readers.npy(str(tmp_path / "d.npy"), {})
