"""A view of a layer that moves: tiles that come into view are rendered by jobs of their own, and jobs of those that leave stop."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Bbox
from .joins import viewport_changes
from .show import Layer, tiles_of_bounds

Tile = tuple[int, int, int]

#: Tiles that a view may have: a screen of 256-pixel tiles has some tens. More is a wrong zoom, not a view.
MOST = 4096


def tiles_of_view(spark: SparkSession, box: Bbox, zoom: int) -> DataFrame:
    """z, x, y of the tiles that a view, a box in degrees, shows."""
    sides: list[Column] = [F.lit(float(v)) for v in box]
    return tiles_of_bounds(spark.range(1), sides, zoom).select("z", "x", "y")


class Viewport:
    """Renders the tiles in view, at most ``at_once`` of them at a time.

    ``render`` gives a frame of one row with a column ``png`` for a tile (z, x, y). Each tile's jobs are a group of their own,
    which ``look`` cancels once the tile has left the view; tiles that wait are withdrawn before they start. A tile
    that comes back is rendered again, one that stays in view goes on. ``done`` is called with each finished tile.
    """

    def __init__(self, spark: SparkSession, render: Callable[[int, int, int], DataFrame], done: Callable[[Tile, bytes | None], None] = lambda tile, png: None, at_once: int = 4):
        self.spark, self.render, self.done = spark, render, done
        self.name = uuid.uuid4().hex
        self.jobs: dict[Tile, tuple[str, Future]] = {}
        self.pool = ThreadPoolExecutor(at_once, thread_name_prefix="viewport")
        self.lock = threading.Lock()
        self.count = 0

    @classmethod
    def of(cls, layer: Layer, **more) -> Viewport:
        """The view of a layer of a map."""
        spark = layer.wide.sparkSession

        def render(z: int, x: int, y: int) -> DataFrame:
            return layer.picture(spark.createDataFrame([(z, x, y)], "z int, x int, y int"))

        return cls(spark, render, **more)

    def look(self, box: Bbox, zoom: int) -> dict[str, list[Tile]]:
        """Moves the view. Gives the tiles whose jobs are withdrawn and those that are submitted, each in order."""
        view = tiles_of_view(self.spark, box, zoom)
        with self.lock:
            now = list(self.jobs)
        current = self.spark.createDataFrame(now, "z int, x int, y int")
        changes = viewport_changes(current, view).limit(2 * MOST + 1).collect()
        changed = {a: sorted((r["z"], r["x"], r["y"]) for r in changes if r["action"] == a) for a in ("cancel", "submit")}
        if len(changed["submit"]) > MOST:
            raise ValueError(f"a view has at most {MOST} tiles; choose a lower zoom than {zoom}")
        for tile in changed["cancel"]:
            self.withdraw(tile)
        for tile in changed["submit"]:
            self.submit(tile)
        return changed

    def submit(self, tile: Tile) -> Future:
        with self.lock:
            if tile in self.jobs:
                return self.jobs[tile][1]
            self.count += 1
            group = f"{self.name}-{self.count}"
            future = self.pool.submit(inheritable_thread_target(self.spark)(self._run), tile, group)
            self.jobs[tile] = (group, future)
            return future

    def _run(self, tile: Tile, group: str) -> bytes | None:
        self.spark.sparkContext.setJobGroup(group, f"tile {tile}")
        if not self._wanted(tile, group):
            return None
        row = self.render(*tile).select("png").head()
        png = None if row is None else bytes(row["png"])
        if self._wanted(tile, group):
            self.done(tile, png)
        return png

    def _wanted(self, tile: Tile, group: str) -> bool:
        with self.lock:
            return self.jobs.get(tile, ("",))[0] == group

    def withdraw(self, tile: Tile) -> None:
        """Stops a tile's jobs, running or not yet begun."""
        with self.lock:
            group, future = self.jobs.pop(tile)
        if not future.cancel() and not future.done():
            self.spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(group)  # also jobs that are only about to begin

    def tile(self, z: int, x: int, y: int, timeout: float | None = None) -> bytes | None:
        """A tile's picture, rendered now if it isn't in view; None where the layer has no such tile."""
        return self.submit((z, x, y)).result(timeout)

    def close(self) -> None:
        with self.lock:
            tiles: Iterable[Tile] = list(self.jobs)
        for tile in tiles:
            self.withdraw(tile)
        self.pool.shutdown(wait=False, cancel_futures=True)
