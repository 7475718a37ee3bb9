"""Mosaics: of the layers over each other, the first valid value from the top."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.frames import ship

NAN = float("nan")
INTEGRAL = {"boolean", "tinyint", "smallint", "int", "bigint"}


def is_nan(x) -> bool:
    return isinstance(x, float) and x != x


def valid_pixel(v: Column, nodata) -> Column:
    """With NaN as nodata, NULL and NaN are invalid. With another nodata only that value (and NULL) is, and NaN counts."""
    return v.isNotNull() & (~F.isnan(v.cast("double")) if is_nan(nodata) else v != F.lit(nodata))


def check_nodata(dtype: str, nodata) -> None:
    if is_nan(nodata) and dtype in INTEGRAL:
        raise ValueError(f"Cannot use NaN as `nodata` for {dtype} values; give a nodata value of that type")


def mosaic(px: DataFrame, by: Sequence[str], order: str | Column, value: str = "v", reverse: bool = False, nodata=NAN, out: str = "v") -> DataFrame:
    """One row for each group of ``by``: the valid value that is last by ``order`` (first with ``reverse``).

    A group without valid values stays, with NULL or the given nodata. ``order`` should be one unique BIGINT: Spark then
    hash-aggregates, with partial results before the one shuffle.
    """
    check_nodata(dict(px.dtypes)[value], nodata)
    v, o = F.col(value), order if isinstance(order, Column) else F.col(order)
    pick = F.min_by if reverse else F.max_by
    found = pick(v, F.when(valid_pixel(v, nodata), o))
    return px.groupBy(*by).agg((found if is_nan(nodata) else F.coalesce(found, F.lit(nodata))).alias(out))


def running_mosaic(px: DataFrame, by: Sequence[str], order: Sequence[str], value: str = "v", out: str = "v") -> DataFrame:
    """The mosaic of all layers up to each one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return px.withColumn(out, F.last(value, ignorenulls=True).over(w))


def mosaic_arrays(layers: Sequence[np.ndarray], reverse: bool = False, nodata=NAN) -> np.ndarray:
    """The same over NumPy blocks, bottom first; stops once every pixel is filled."""
    if is_nan(nodata) and np.asarray(layers[0]).dtype.kind in "biu":
        raise ValueError(f"Cannot use NaN as `nodata` for {np.asarray(layers[0]).dtype} values; give a nodata value of that type")
    gaps = np.isnan if is_nan(nodata) else lambda a: a == nodata
    out = None
    for layer in layers if reverse else reversed(layers):
        if out is None:
            out = np.array(layer)
        else:
            np.copyto(out, layer, where=todo)
        todo = gaps(out)
        if not todo.any():
            break
    return out


@dataclass
class Layered:
    """A block's pixels so far, NaN where there is none, and which layer each is from: one number, or one a pixel."""

    v: np.ndarray
    layer: np.ndarray

    def over(self, below: Layered) -> Layered:
        """This block's pixels where they are valid and from a higher layer, else the other's."""
        mine = ~np.isnan(self.v) & (np.isnan(below.v) | (self.layer > below.layer))
        return Layered(np.where(mine, self.v, below.v), np.where(mine, self.layer, below.layer))

    def covers(self, highest: int) -> bool:
        """Whether every pixel is there, from a layer that nothing up to ``highest`` is above of."""
        return bool(self.layer.min() > highest and not np.isnan(self.v).any())


#: Pixels of blocks that layers dealt to one partition come to.
LAYERED_PIXELS = 1 << 26
#: Bytes of blocks that a task merges before it hands them on.
MERGED_BYTES = 128 << 20


def dealt_layers(layers: DataFrame, by: Sequence[str], order: str, pixels: int) -> DataFrame:
    """Layers that their blocks (of so many pixels) aren't read of yet, dealt out for it by ranges of group and order.

    A file of small rows is one task, whatever their blocks come to. Partitions get LAYERED_PIXELS at most, or fewer if there
    are cores for more; as each has few groups, `mosaic_blocks` hands on about one row a partition and one a group.
    """
    parts = max(layers.sparkSession.sparkContext.defaultParallelism, layers.count() * pixels // LAYERED_PIXELS + 1)
    return layers.repartitionByRange(parts, *by, order)


def mosaic_blocks(blocks: DataFrame, by: Sequence[str], order: str, data: str = "data", reverse: bool = False) -> DataFrame:
    """Blocks stay blocks: of the arrays of each group of ``by``, every pixel's valid value that is last by ``order``.

    NULL and NaN are missing. A NULL block or order is no layer, a group without layers has no row, and a group's blocks must
    have one length. ``order`` must
    be a whole number; of equal ones either value is taken. Tasks merge the blocks they read, so at most one row a task and
    group is shuffled, and what arrives is merged row by row, the highest first; blocks below a full mosaic aren't opened.
    """
    kinds = dict(blocks.dtypes)
    names, turn = list(by), -1 if reverse else 1
    state = ", ".join([*[f"`{c}` {kinds[c]}" for c in names], "_top long", "_layer array<long>", f"`{data}` {kinds[data]}"])
    kind = to_arrow_type(blocks.schema[data].dataType)

    def opened(batch: pa.RecordBatch, i: int) -> np.ndarray | None:
        cell = batch.column(batch.schema.get_field_index(data))[i]
        return cell.values.to_numpy(zero_copy_only=False).astype(float) if cell.is_valid else None

    def row(key: tuple, s: Layered, schema: pa.Schema) -> pa.RecordBatch:
        top, same = int(s.layer.max()) if len(s.layer) else 0, len(s.layer) and (s.layer == s.layer[0]).all()
        lists = [pa.array([s.layer[:1] if same else s.layer], pa.list_(pa.int64())), pa.array([pa.array(s.v, mask=np.isnan(s.v)).to_pylist()], kind)]
        return pa.RecordBatch.from_arrays([*[pa.array([k], f.type) for k, f in zip(key, schema, strict=False)], pa.array([top]), *lists], [*names, "_top", "_layer", data])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Layered] = {}
        size = 0
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in names], strict=True)) if names else [()] * len(batch)
            for i, (key, layer) in enumerate(zip(keys, batch.column("_order").to_pylist(), strict=True)):
                v = opened(batch, i)
                if v is None or layer is None:
                    continue
                new = Layered(v, np.full(len(v), turn * layer))
                size += 0 if key in held else 16 * len(v)
                held[key] = new.over(held[key]) if key in held else new
                if size > MERGED_BYTES:
                    yield from (row(k, s, batch.schema) for k, s in held.items())
                    held, size = {}, 0
            schema = batch.schema
        if held:
            yield from (row(k, s, schema) for k, s in held.items())

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state_ = None, None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in names], strict=True)) if names else [()] * len(batch)
            for i, (key, top) in enumerate(zip(keys, batch.column("_top").to_pylist(), strict=True)):
                if last is not None and key != last:
                    yield row(last, state_, batch.schema).select([*names, data])
                    state_ = None
                last = key
                if state_ is not None and state_.covers(top):
                    continue
                v, layer = opened(batch, i), batch.column("_layer")[i].values.to_numpy()
                new = Layered(v, np.full(len(v), layer[0]) if len(layer) == 1 else layer)
                state_ = new if state_ is None else state_.over(new)
            schema = batch.schema
        if last is not None:
            yield row(last, state_, schema).select([*names, data])

    ship(blocks.sparkSession)
    some = blocks.select(*names, F.col(order).cast("long").alias("_order"), data).mapInArrow(merge, state)
    some = some.repartition(*names).sortWithinPartitions(*names, F.col("_top").desc()) if names else some.coalesce(1).sortWithinPartitions(F.col("_top").desc())
    return some.mapInArrow(finish, ", ".join([*[f"`{c}` {kinds[c]}" for c in names], f"`{data}` {kinds[data]}"]))
