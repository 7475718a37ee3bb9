import time

import pytest
from pyspark.sql import functions as F

from quadrille.functions.grid import GridSpec
from quadrille.operators import show
from quadrille.operators.viewport import Viewport, tiles_of_view

WORLD = (-179.0, -80.0, 179.0, 80.0)
SPEC = GridSpec(32613, (400000.0, 3900000.0, 400640.0, 3900480.0), (10.0, 10.0))


def until(ready, seconds=60):
    end = time.time() + seconds
    while not ready() and time.time() < end:
        time.sleep(0.05)
    return ready()


@pytest.fixture
def slow(spark, tmp_path):
    """Renders a tile in a task that writes a file when it begins, waits while its ``slow`` file is there, and then ends."""
    log = str(tmp_path)

    def render(z, x, y):
        def run(batches):
            import os
            import time

            for b in batches:
                open(f"{log}/begun-{z}-{x}-{y}", "w").close()
                while os.path.exists(f"{log}/slow-{z}-{x}-{y}"):
                    time.sleep(0.05)
                open(f"{log}/ended-{z}-{x}-{y}", "w").close()
                yield b

        return spark.range(1).select(F.encode(F.lit(f"{z}/{x}/{y}"), "utf-8").alias("png")).mapInArrow(run, "png binary")

    return render, tmp_path


def test_jobs_of_tiles_that_left_the_view_stop(spark, slow):
    render, log = slow
    for tile in ("1-0-0", "1-0-1", "1-1-0"):
        (log / f"slow-{tile}").touch()
    finished = {}
    v = Viewport(spark, render, finished.__setitem__, at_once=3)
    try:
        changed = v.look(WORLD, 1)
        assert changed == {"cancel": [], "submit": [(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)]}
        assert until(lambda: len(list(log.glob("begun-*"))) == 3)  # the fourth waits for a place
        gone = {t: v.jobs[t][1] for t in [(1, 0, 0), (1, 0, 1)]}
        assert v.look((1.0, -80.0, 179.0, 80.0), 1) == {"cancel": [(1, 0, 0), (1, 0, 1)], "submit": []}
        for future in gone.values():
            assert until(future.done) and future.exception() is not None  # interrupted: their slow files are still there
        (log / "slow-1-1-0").unlink()
        assert until(lambda: len(finished) == 2)
        assert finished == {(1, 1, 0): b"1/1/0", (1, 1, 1): b"1/1/1"}
        assert {f.name for f in log.glob("ended-*")} == {"ended-1-1-0", "ended-1-1-1"}
        (log / "slow-1-0-0").unlink()  # it comes back and is rendered anew
        assert v.look((-179.0, 1.0, 179.0, 80.0), 1) == {"cancel": [(1, 1, 1)], "submit": [(1, 0, 0)]}
        assert until(lambda: (1, 0, 0) in finished) and v.tile(1, 1, 0) == b"1/1/0"
    finally:
        v.close()


def test_tiles_that_wait_never_begin(spark, slow):
    render, log = slow
    (log / "slow-1-0-0").touch()
    v = Viewport(spark, render, at_once=1)
    try:
        v.look(WORLD, 1)
        assert until(lambda: (log / "begun-1-0-0").exists())
        assert v.look((-179.0, 1.0, -1.0, 80.0), 1)["cancel"] == [(1, 0, 1), (1, 1, 0), (1, 1, 1)]
        (log / "slow-1-0-0").unlink()
        assert v.tile(1, 0, 0, 60) == b"1/0/0"
        assert {f.name for f in log.glob("begun-*")} == {"begun-1-0-0"}
        with pytest.raises(ValueError, match="lower zoom"):
            v.look(WORLD, 9)
        assert list(v.jobs) == [(1, 0, 0)]
    finally:
        v.close()


def test_a_view_of_a_layer_shows_the_layers_tiles(spark):
    p = spark.range(64 * 48).select((F.col("id") % 48).cast("int").alias("iy"), (F.col("id") / 48).cast("int").alias("ix"))
    layer = show.Map().add(p.withColumn("red", F.col("iy") * 2.0 + F.col("ix")), "red", SPEC, vrange=(0, 160), tilesize=16)
    want = {(r["z"], r["x"], r["y"]): bytes(r["png"]) for r in layer.tiles([15]).collect()}
    got = {}
    v = Viewport.of(layer, done=got.__setitem__)
    try:
        assert set(map(tuple, v.look(layer.box(), 15)["submit"])) == set(want)
        assert {tuple(r) for r in tiles_of_view(spark, layer.box(), 15).collect()} == set(want)
        assert until(lambda: len(got) == len(want)) and got == want
    finally:
        v.close()
