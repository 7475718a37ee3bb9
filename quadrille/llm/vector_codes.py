"""Vectors as short codes: each is cut into parts, and a part is replaced by the number of its codebook's nearest entry.

Codebooks are fitted by Lloyd's rounds in integers. A part keeps one number, its slack: a lower bound of the distance to
any other entry minus an upper bound of that to its own. When entries move, a slack shrinks at most by what the own entry
moved and the most that any other did. These drifts are added up for each entry, and a slack is stored with the sum as it
was, so it never needs to be updated. Each block of vectors has a heap of slacks for each entry; a round pops the parts
whose slack the drift has used up, compares them with all entries exactly, and leaves all other parts alone.

Blocks with their heaps are rows of a table that each round writes anew, in the shared folder, so a lost executor costs
the tasks it ran. The round before is removed then. What comes to the driver is one row an entry: how many parts came to
it or left it, and their sums.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import same, shared_folder, ship, small, trimmed

#: Vectors in a block.
BLOCK = 4096
#: Slacks this near to the drift count as used up, for rounding.
MARGIN = 1e-6
#: Components beyond it have squared distances that a long can't hold.
LARGEST = 1 << 26


@dataclass(frozen=True)
class Spec:
    """Parts of a vector, entries of a codebook (256 at most), rounds, and what components are multiplied by."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    id_col: str = "vec_id"
    vector_col: str = "embedding"
    label_col: str = "label"


@dataclass
class Codebooks:
    """entries (part, entry, place) as whole numbers; drift (part, entry): by how much slacks have shrunk so far."""

    entries: np.ndarray
    drift: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.drift is None:
            self.drift = np.zeros(self.entries.shape[:2])

    def moved(self, entries: np.ndarray) -> Codebooks:
        step = np.sqrt(((entries - self.entries).astype(float) ** 2).sum(2))
        order = np.sort(step, axis=1)
        most = order[:, -1:]
        other = np.where(step == most, order[:, -2:-1] if step.shape[1] > 1 else 0, most)  # the most that any other entry moved
        return Codebooks(entries, self.drift + step + other)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, slack) of every row: the nearest entry, of equally near ones the first, by exact squared distances."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * most * most * x.shape[1] < 1 << 53 else np.int64  # floats are exact up to there, and faster
    x, c = x.astype(kind), entries.astype(kind)
    d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    row, best = np.arange(len(x)), d.argmin(1)
    own = d[row, best].astype(float)
    if len(c) == 1:
        return best, np.full(len(x), np.inf)
    d[row, best] = np.inf if kind is np.float64 else np.iinfo(np.int64).max
    return best, np.sqrt(d.min(1).astype(float)) - np.sqrt(own)


class Heaps:
    """The heaps of one part of a block, one for each entry, one after the other: slacks, vectors, and where each begins."""

    def __init__(self, slack: np.ndarray, vector: np.ndarray, begin: np.ndarray):
        self.slack, self.vector, self.begin = slack, vector, begin

    @staticmethod
    def of(entry: np.ndarray, slack: np.ndarray, n: int) -> Heaps:
        order = np.lexsort((slack, entry))  # what is sorted is a heap
        return Heaps(slack[order], order.astype(np.int32), np.searchsorted(entry[order], np.arange(n + 1)).astype(np.int32))

    def examine(self, x: np.ndarray, entries: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pops the parts whose slack is used up and puts them on the heaps they belong to: vectors, entries before and now."""
        begin, n = self.begin, len(entries)
        limit = drift + MARGIN * (1 + drift)
        full = np.flatnonzero(begin[1:] > begin[:-1])
        open_: dict[int, list[tuple[float, int]]] = {}

        def heap(e: int) -> list[tuple[float, int]]:
            if e not in open_:
                a, b = begin[e], begin[e + 1]
                open_[e] = list(zip(self.slack[a:b].tolist(), self.vector[a:b].tolist(), strict=True))
            return open_[e]

        popped: list[int] = []
        before: list[int] = []
        for e in full[self.slack[begin[full]] <= limit[full]].tolist():
            h, most = heap(e), float(limit[e])
            while h and h[0][0] <= most:
                popped.append(heapq.heappop(h)[1])
                before.append(e)
        vectors, old = np.array(popped, np.int64), np.array(before, np.int64)
        if not popped:
            return vectors, old, old
        new, slack = nearest(x[vectors], entries)
        for v, e, s in zip(popped, new.tolist(), (slack + drift[new]).tolist(), strict=True):
            heapq.heappush(heap(e), (s, v))
        lists = [open_.get(e) for e in range(n)]
        sizes = [len(h) if h is not None else int(begin[e + 1] - begin[e]) for e, h in enumerate(lists)]
        slacks = [np.array([s for s, _ in h]) if h is not None else self.slack[begin[e] : begin[e + 1]] for e, h in enumerate(lists)]
        places = [np.array([v for _, v in h], np.int32) if h is not None else self.vector[begin[e] : begin[e + 1]] for e, h in enumerate(lists)]
        self.slack, self.vector = np.concatenate(slacks), np.concatenate(places)
        self.begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return vectors, old, new

    def entry(self) -> np.ndarray:
        out = np.empty(len(self.vector), np.int64)
        out[self.vector] = np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))
        return out


class Totals:
    """How many parts came to each entry and left it in a task, and the sums of their components."""

    def __init__(self, shape: tuple[int, int, int]):
        self.n, self.sums = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)

    def add(self, part: int, entry: np.ndarray, x: np.ndarray, sign: int) -> None:
        np.add.at(self.n[part], entry, sign)
        np.add.at(self.sums[part], entry, sign * x)


def whole_numbers(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), width) * scale)
    if np.abs(x).max(initial=0) > LARGEST:
        raise ValueError(f"components beyond {LARGEST / scale} have squared distances that a long can't hold")
    x = x.astype(np.int32)
    return x.astype(np.int16) if np.abs(x).max(initial=0) < 1 << 15 else x


@dataclass
class Compressed:
    """codes: id, label, code (bytes of the entries as hexadecimal digits) and error (squared distance, whole numbers)."""

    codes: DataFrame
    codebooks: np.ndarray


#: A row is a block (with its heaps) or, with a part, what a task adds to an entry.
STATE = "size int, matrix binary, slack binary, vector binary, begin binary, part int, entry int, n long, total array<long>"


def compress(vectors: DataFrame, spec: Spec = Spec()) -> Compressed:
    """Codes of all rows whose vector is not null and has only finite components, and the codebooks (part, entry, place).

    The codebooks begin with the vectors of the smallest identifiers (null is the largest; of equal ones the smaller
    vector first); there are fewer entries if there are fewer vectors. Rows that repeat are coded each. The smallest
    identifier's vector tells how many components there are; rows with another number of them are dropped, too, and a
    number that can't be cut into equal parts raises. Of equally near entries the first is taken. Other columns, whatever
    their names, are not read. Without rows there are no codes and no entries.
    """
    spark = vectors.sparkSession
    ship(spark)
    v, infinity = F.col(spec.vector_col), F.lit(float("inf"))
    rows = vectors.select(F.col(spec.id_col).alias("id"), v.alias("vector"), F.col(spec.label_col).alias("label"))
    rows = rows.filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: F.coalesce(F.abs(x) < infinity, F.lit(False))))
    kinds = dict(rows.dtypes)
    coded = f"id {kinds['id']}, label {kinds['label']}, code string, error long"
    width, first = -1, rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(spec.entries).collect()
    if first:
        width = len(first[0]["vector"])
        rows = rows.filter(F.size("vector") == width)
        if any(len(r["vector"]) != width for r in first):
            first = rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(spec.entries).collect()
    else:
        return Compressed(spark.createDataFrame([], coded), np.empty((spec.parts, 0, 0), np.int64))
    if width % spec.parts:
        raise ValueError(f"{width} components can't be cut into {spec.parts} equal parts")
    each = width // spec.parts
    seeds = whole_numbers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), width, spec.scale).astype(np.int64)
    books = Codebooks(np.stack([seeds[:, p * each : (p + 1) * each] for p in range(spec.parts)]))
    shape = books.entries.shape
    state = f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, {STATE}"
    arrow = pa_schema(state, spark)

    def part_of(x: np.ndarray, p: int) -> np.ndarray:
        return x[:, p * each : (p + 1) * each].astype(np.int64)

    def block_row(ids: pa.Array, labels: pa.Array, x: np.ndarray, heaps: list[Heaps]) -> pa.RecordBatch:
        packed = [np.concatenate([getattr(h, k) for h in heaps]).tobytes() for k in ("slack", "vector", "begin")]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (ids, labels)]
        cols = [*lists, pa.array([x.dtype.itemsize], pa.int32()), pa.array([x.tobytes()]), *[pa.array([p]) for p in packed], *[pa.nulls(1)] * 4]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    def total_rows(t: Totals) -> Iterator[pa.RecordBatch]:
        part, entry = np.nonzero((t.n != 0) | (t.sums != 0).any(2))
        if len(part):
            ends = pa.array(np.arange(0, len(part) * each + 1, each or 1)[: len(part) + 1] if each else np.zeros(len(part) + 1), pa.int32())
            cols = [*[pa.nulls(len(part))] * 7, pa.array(part), pa.array(entry), pa.array(t.n[part, entry]), pa.ListArray.from_arrays(ends, pa.array(t.sums[part, entry].ravel()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    def begin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows to blocks: every part is compared with every entry once."""
        totals, held = Totals(shape), []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, vector, label = (t.column(i).combine_chunks() for i in range(3))
            x, heaps = whole_numbers(vector, width, spec.scale), []
            for p in range(spec.parts):
                part = part_of(x, p)
                entry, slack = nearest(part, books.entries[p])
                totals.add(p, entry, part, 1)
                heaps.append(Heaps.of(entry, slack, shape[1]))
            held.clear()
            return block_row(ids, label, x, heaps)

        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(a, BLOCK))
                if sum(len(b) for b in held) >= BLOCK:
                    yield block()
        if sum(len(b) for b in held):
            yield block()
        yield from total_rows(totals)

    def opened(batch: pa.RecordBatch, i: int) -> tuple[pa.Array, pa.Array, np.ndarray, list[Heaps]]:
        ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
        size, matrix, slack, vector, start = (batch.column(k)[i].as_py() for k in range(2, 7))
        x = np.frombuffer(matrix, {2: np.int16, 4: np.int32}[size]).reshape(len(ids), width)
        cut = [np.frombuffer(b, kind).reshape(spec.parts, -1) for b, kind in ((slack, np.float64), (vector, np.int32), (start, np.int32))]
        return ids, labels, x, [Heaps(*(c[p] for c in cut)) for p in range(spec.parts)]

    def again(now: Codebooks):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = Totals(shape)
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, labels, x, heaps = opened(batch, i)
                    for p, h in enumerate(heaps):
                        part = part_of(x, p)
                        vectors, old, new = h.examine(part, now.entries[p], now.drift[p])
                        other = old != new
                        totals.add(p, old[other], part[vectors[other]], -1)
                        totals.add(p, new[other], part[vectors[other]], 1)
                    yield block_row(ids, labels, x, heaps)
            yield from total_rows(totals)

        return trimmed(run)

    def finish(now: Codebooks):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, labels, x, heaps = opened(batch, i)
                    code, error = np.empty((len(ids), spec.parts), np.uint8), np.zeros(len(ids), np.int64)
                    for p, h in enumerate(heaps):
                        part = part_of(x, p)
                        h.examine(part, now.entries[p], now.drift[p])
                        entry = h.entry()
                        code[:, p] = entry
                        error += ((part - now.entries[p][entry]) ** 2).sum(1)
                    digits, n = code.tobytes().hex(), 2 * spec.parts
                    codes = pa.array([digits[k : k + n] for k in range(0, len(digits), n)], pa.string())
                    yield pa.RecordBatch.from_arrays([ids, labels, codes, pa.array(error)], ["id", "label", "code", "error"])

        return trimmed(run)

    blocks = [f.name for f in spark.createDataFrame([], state).schema.fields]
    n, sums = np.zeros(shape[:2], np.int64).astype(object), np.zeros(shape, np.int64).astype(object)
    table, path = rows, None
    for r in range(spec.rounds):
        source = table if path is None else table.filter("part IS NULL")
        made = source.mapInArrow(trimmed(begin) if path is None else again(books), state)
        last, path = path, shared_folder(spark, "codes")
        made.write.parquet(path)
        if last:
            remove(spark, last)
        table = spark.read.schema(made.schema).parquet(path).select(*blocks)
        added = table.filter("part IS NOT NULL").groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", i)).alias(f"s{i}") for i in range(each)])
        for row in added.collect():  # one row an entry
            n[row["part"], row["entry"]] += row["n"]
            sums[row["part"], row["entry"]] += [row[f"s{i}"] for i in range(each)]
        means = books.entries.copy()
        for p, e in zip(*np.nonzero(n), strict=True):
            means[p, e] = [s // n[p, e] for s in sums[p, e]]
        books = books.moved(means)
    if path is None:  # no rounds: the first comparison is the last
        raise ValueError("at least one round is needed")
    return Compressed(table.filter("part IS NULL").mapInArrow(finish(books), coded), books.entries)


def pa_schema(ddl: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def remove(spark, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def report(vectors: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """Codes and errors, the error of all vectors of the same label (nulls together), and the digest of the codebooks."""
    got = compress(vectors, spec)
    path = shared_folder(vectors.sparkSession, "coded")
    got.codes.write.parquet(path)
    codes = vectors.sparkSession.read.schema(got.codes.schema).parquet(path)
    errors = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    out = codes.join(small(errors), same(codes["label"], errors["_label"]))
    return out.select(F.col("id").alias(spec.id_col), "code", "error", "label_error", F.lit(Codebooks(got.codebooks).sha256()).alias("codebooks_sha256"))


def _oracle(spec: Spec) -> str:
    """The same by plain SQL: every part is compared with every entry in every round."""
    ctes = [
        f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({spec.scale} * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), 'bool_and'))""",
        f"""cut AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {spec.parts}) + 1 : (p + 1) * (len(v) // {spec.parts})] AS x FROM kept, range({spec.parts}) AS t(p))""",
        f"""first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {spec.entries})""",
        """book0 AS MATERIALIZED (SELECT p, e, x AS c FROM cut JOIN first USING (vec_id))""",
    ]
    for r in range(spec.rounds + 1):
        ctes.append(
            f"""near{r} AS MATERIALIZED (SELECT vec_id, label, cut.p, x, min(CAST(list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS BIGINT) * 256 + e) AS best
    FROM cut JOIN book{r} AS b ON cut.p = b.p GROUP BY vec_id, label, cut.p, x)"""
        )
        if r < spec.rounds:
            ctes.append(
                f"""sum{r} AS (SELECT p, best % 256 AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM near{r}, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL)"""
            )
            ctes.append(
                f"""book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM book{r} LEFT JOIN
    (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS m FROM sum{r} GROUP BY p, e) USING (p, e))"""
            )
    last = spec.rounds
    ctes.append(f"""codes AS (SELECT vec_id, label, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM near{last} GROUP BY vec_id, label)""")
    ctes.append(f"""digest AS (SELECT sha256(string_agg(list_aggregate(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{last})""")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes, digest"


#: For unique identifiers.
ORACLE = _oracle(Spec())
