"""Jaccard join of word-shingle sets by PartEnum signatures, and the groups that its links form.

Sets whose sizes are in one band or in neighbouring bands can only reach the threshold if they differ in at most k
features. The feature domain (64-bit shingle hashes) is cut into ranges and each range into PARTS parts; a range's
signatures are those of all but one of its parts. By the pigeonhole principle at least one range has differences in one
part at most, so similar sets share the signature that leaves this part out. A piece that is empty says nothing and is
not emitted; a set with more empty pieces than the cut has to spare emits signatures under further cuts of the domain
until it has few enough, and in the last cut its empty pieces too. Two sets can only miss each other under a cut if both
have too many empty pieces, so no link is lost.

Signatures travel as packed blocks and are grouped by value; groups of the same sets under different signatures become
one. A signature that more than HOT sets of one map task's block share is not sent to the task of its value: its sets
are dealt to SALTS lists. Texts with a passage in common share many hot signatures, each held by nearly the same sets;
signatures whose sets have the least in common, by hash, become one group, several times over. A group that is joined
to another loses no pair, and its sets are compared once instead of under each of its signatures. A joined group's lists
are united before they become rows.

Within a group, sets are first compared by sketch: the parities of the numbers of features in about as many slots as the
set has features. Two sets differ in at least as many features as their sketches do in bits, so sets that link have near
sketches; unlike sets that share a signature by chance (a passage in common) hardly ever do. Sets that near sketches
connect form clusters, and their features are compared exactly, by overlap counts of one set against all that are not
yet reached, again and again; no pairs are written.

Groups and clusters above a bound are cut into blocks (see ``trees``): each block is joined with HUBS of the group's
sets. What that connects to one component needs no more comparing; only sets outside of the largest component meet the
other blocks. A group of near copies of any size thus takes one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .common import only_kept, salted, same, settle, ship, stored, trimmed
from .components import SALTS, components

U = np.uint64
CUTS = 6
PARTS = 3
#: Rows of signatures that a map task holds before it combines and sends them; 14 bytes each.
HELD = 500_000
#: Sets under one signature in such a block from which the signature's sets are dealt out as rows.
HOT = 8
#: Times that groups of hot signatures are joined by the least hash of their sets.
MERGES = 3
#: Features of a cluster, and sketches of a group, that one task compares.
FEATURES = 1_000_000
SKETCHES = 8192
#: Sets of a large group that every block of it is compared with.
HUBS = 8
#: Bits of the filter that names the sets to compare, a power of two, at least and at most (32 MB).
LEAST_BITS, MOST_BITS = 20, 28

SIGNATURE = np.dtype([("low", "<u4"), ("high", "<u2"), ("node", "<u8")])
DOCUMENT = np.dtype([("id", "<i8"), ("null", "?"), ("text", "<i8"), ("node", "<u8"), ("n", "<i8")])
PAIR = np.dtype([("sig", "<u8"), ("node", "<u8")])
LOW48 = U((1 << 48) - 1)
#: Kinds of rows: signatures, signatures that are hot (map side only); documents, groups, sketches, sets of hot signatures.
SIGNED, MARKS, DOCS, GROUPS, SKETCH, DEALT = range(6)


@dataclass(frozen=True)
class Spec:
    """percent: links have 100 * intersection >= percent * union."""

    n: int = 5
    percent: int = 80

    def bands(self, most: int) -> np.ndarray:
        """The largest size of each band; a set links with sets of its own band and its two neighbours only."""
        tops = [1]
        while tops[-1] < most:
            tops.append((tops[-1] + 1) * 100 // self.percent)
        return np.array(tops, np.int64)

    def shape(self, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For bands whose sets have at most ``top`` features: ranges, and how many of them are to spare.

        k differences make at most k // 2 ranges differ in two parts or more.
        """
        k = (100 - self.percent) * 2 * top // (100 + self.percent)
        spare = k // 16
        return np.where(k > 0, k // 2 + 1 + spare, 0), spare


def signatures(spec: Spec, text: np.ndarray, value: np.ndarray, sizes: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, node) of every set, whose features are sorted by (text, value)."""
    out_s, out_n = [np.empty(0, U)], [np.empty(0, U)]
    if not len(value):
        return out_s[0], out_n[0]
    tops = spec.bands(int(sizes.max()))
    own = np.searchsorted(tops, sizes)
    tops = np.append(tops, (tops[-1] + 1) * 100 // spec.percent)
    n_texts = len(sizes)
    for step in (0, 1):
        band = own + step
        ranges, spare = spec.shape(tops[band])
        left = np.flatnonzero((ranges > 0) & (sizes > 0))
        for cut in range(CUTS):
            if not len(left):
                break
            pick = np.zeros(n_texts, bool)
            pick[left] = True
            some = pick[text]
            t, v = text[some], value[some]
            if cut:
                v = kernel.mix(v + U(cut * kernel.M2 & (2**64 - 1)))
                order = np.lexsort((v, t))
                t, v = t[order], v[order]
            pieces = ranges * PARTS
            base = np.zeros(n_texts + 1, np.int64)
            np.cumsum(np.where(pick, pieces, 0), out=base[1:])
            piece = base[t] + (((v >> U(32)) * pieces[t].astype(U)) >> U(32)).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            sums, counts = np.zeros(base[-1], U), np.zeros(base[-1], np.int64)
            sums[piece[starts]] = np.add.reduceat(kernel.mix(v), starts)
            counts[piece[starts]] = np.diff(np.r_[starts, len(piece)])
            last = cut == CUTS - 1
            empty = np.zeros(n_texts, np.int64)
            n = ranges[left]
            of = np.repeat(left, n)  # the text of each range
            number = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            sums, counts = sums.reshape(-1, PARTS), counts.reshape(-1, PARTS)
            all_s, all_c = sums.sum(1, dtype=U), counts.sum(1)
            none = np.zeros(len(of), bool)
            for j in range(PARTS):
                s, c = all_s - sums[:, j], all_c - counts[:, j]
                name = kernel.mix(U(spec.percent * 64 + spec.n) + (band[of] * 8 + cut).astype(U) * U(kernel.BASE)) + (number * 4 + j).astype(U)
                sig = kernel.mix(s + kernel.mix(name))
                none |= c == 0
                emit = np.ones(len(of), bool) if last else c > 0
                out_s.append(sig[emit])
                out_n.append(node[of[emit]])
            np.add.at(empty, of[none], 1)
            left = left[empty[left] > spare[left]]
    return np.concatenate(out_s), np.concatenate(out_n)


def width(sizes: np.ndarray) -> np.ndarray:
    """Slots of a sketch: a power of two, as many as features at least."""
    return 1 << np.ceil(np.log2(np.maximum(sizes, 64))).astype(np.int64)


def sketches(text: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A bit for every slot, which tells whether an odd number of features fell into it; slots are a hash's low bits."""
    bits = width(sizes)
    base = np.r_[0, np.cumsum(bits)]
    slot = base[text] + (kernel.mix(value) & (bits[text] - 1).astype(U)).astype(np.int64)
    odd = np.packbits((np.bincount(slot, minlength=base[-1]) & 1).astype(np.uint8), bitorder="little")
    return [odd[a:b].tobytes() for a, b in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist(), strict=True)]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def distinct_pairs(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, sorted, and where each signature begins (and the end)."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    if len(sig):
        new = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
        sig, node = sig[new], node[new]
    return sig, node, np.flatnonzero(np.r_[True, sig[1:] != sig[:-1], True]) if len(sig) else np.zeros(1, np.int64)


def emitter(spec: Spec, buckets: int):
    """Map side: blocks of documents, of sketches, of hot signatures' sets, and of signatures by bucket."""

    def blocks(held: list, docs: list, shapes: dict) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes]] = []
        if docs:
            block = np.concatenate(docs)
            rows.append((int(block["node"][0] % U(buckets)), DOCS, block.tobytes()))
        for node, x in shapes.items():
            rows.append((node % buckets, SKETCH, node.to_bytes(8, "little") + x))
        if held:
            sig, node, cuts = distinct_pairs(np.concatenate([s for s, _ in held]), np.concatenate([n for _, n in held]))
            hot = np.diff(cuts) > HOT
            first, hot = sig[cuts[:-1]], np.repeat(hot, np.diff(cuts))
            dealt = np.empty(int(hot.sum()), PAIR)
            dealt["sig"], dealt["node"] = sig[hot] & LOW48, node[hot]
            bucket = kernel.mix(dealt["sig"] + dealt["node"] % U(SALTS)) % U(buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, dealt = bucket[order], dealt[order]
            ends = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(dealt) else np.zeros(1, np.int64)
            rows += [(int(bucket[x]), DEALT, dealt[x:y].tobytes()) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            marks = first[np.diff(cuts) > HOT]
            sig, node = sig[~hot], node[~hot]
            packed = np.empty(len(sig), SIGNATURE)
            packed["low"], packed["high"], packed["node"] = sig & U(0xFFFFFFFF), (sig >> U(32)) & U(0xFFFF), node
            for kind, s, block in ((SIGNED, sig, packed), (MARKS, marks, marks & LOW48)):
                bucket = ((s >> U(32)) * U(buckets)) >> U(32)
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(s) else np.zeros(1, np.int64)
                rows += [(int(bucket[x]), kind, block[x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in range(0, len(rows), 256):
            b, k, x = zip(*rows[i : i + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], ["bucket", "kind", "block"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, shapes, n = [], [], {}, 0
        for batch in batches:
            ids = batch.column(0)
            null = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0))
            hashes = np.asarray(batch.column(2))
            for a, b, data, bounds in kernel.texts(batch.column(1)):
                text, value = kernel.shingles(kernel.split(data, bounds), spec.n)
                sizes, node = kernel.set_keys(text, value, b - a)
                rows = np.empty(b - a, DOCUMENT)
                rows["id"], rows["null"], rows["text"], rows["node"], rows["n"] = ids[a:b], null[a:b], hashes[a:b], node, sizes
                docs.append(rows)
                held.append(signatures(spec, text, value, sizes, node))
                for i, x in enumerate(sketches(text, value, sizes)):
                    if sizes[i]:
                        shapes[int(node[i])] = int(sizes[i]).to_bytes(8, "little") + x
                n += len(held[-1][0]) + b - a
                if n >= HELD:
                    yield from blocks(held, docs, shapes)
                    held, docs, shapes, n = [], [], {}, 0
        yield from blocks(held, docs, shapes)

    return run


GATHERED = "kind int, a long, b long, c long, n long, sets array<long>, sketch binary"


def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side, bucket by bucket.

    DOCS: a identifier, b hash of the text, c node, n size. GROUPS: a and b name the sets, n of them. SKETCH: c node,
    n size, sketch. DEALT: a signature, n of its sets, all of the part c of SALTS; a signature has several such rows.
    """
    names = [c.split()[0] for c in GATHERED.split(", ")]

    def rows(kind: int, size: int, a=None, b=None, c=None, n=None, sets=None, sketch=None) -> pa.RecordBatch:
        none = pa.nulls(size, pa.int64())
        columns = [pa.array(np.full(size, kind, np.int32)), *[none if x is None else x if isinstance(x, pa.Array) else signed(x) for x in (a, b, c, n)]]
        columns.append(pa.nulls(size, pa.list_(pa.int64())) if sets is None else sets)
        columns.append(pa.nulls(size, pa.binary()) if sketch is None else sketch)
        return pa.RecordBatch.from_arrays(columns, names)

    def lists(node: np.ndarray, cuts: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Lengths and nodes of the groups m."""
        count = np.diff(cuts)[m]
        ends = np.r_[0, np.cumsum(count)]
        at = np.repeat(cuts[m] - ends[:-1], count) + np.arange(ends[-1])
        return count, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), signed(node[at]))

    def hot_lists(sig: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        sig, node, _ = distinct_pairs(sig, node)
        salt = node % U(SALTS)
        order = np.lexsort((salt, sig))
        sig, node, salt = sig[order], node[order], salt[order]
        cuts = np.flatnonzero(np.r_[True, (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1]), True])
        for i in range(0, len(cuts) - 1, 10_000):
            m = np.arange(i, min(i + 10_000, len(cuts) - 1))
            count, sets = lists(node, cuts, m)
            yield rows(DEALT, len(m), a=sig[cuts[m]], c=salt[cuts[m]], n=count, sets=sets)

    def close(parts: list, marks: list, dealt: list) -> Iterator[pa.RecordBatch]:
        if dealt:
            d = np.concatenate(dealt)
            yield from hot_lists(d["sig"], d["node"])
        if not parts:
            return
        p = np.concatenate(parts)
        sig, node, cuts = distinct_pairs((p["high"].astype(U) << U(32)) | p["low"].astype(U), p["node"])
        if marks:
            hot = np.isin(sig, np.concatenate(marks))
            if hot.any():
                yield from hot_lists(sig[hot], node[hot])
                sig, node, cuts = distinct_pairs(sig[~hot], node[~hot])
        count = np.diff(cuts)
        if not (count > 1).any():
            return
        one, two = (np.add.reduceat(kernel.mix(node + U(x)), cuts[:-1]) for x in (kernel.M1, kernel.M2))
        many = np.flatnonzero(count > 1)
        _, first = np.unique(np.stack([one[many], two[many]]), axis=1, return_index=True)
        many = many[first]
        for i in range(0, len(many), 10_000):
            m = many[i : i + 10_000]
            size, sets = lists(node, cuts, m)
            yield rows(GROUPS, len(m), a=one[m], b=two[m], n=size, sets=sets)

    bucket, parts, marks, dealt = None, [], [], []
    for batch in batches:
        for at, kind, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            block = block.as_buffer()
            if at != bucket:
                yield from close(parts, marks, dealt)
                bucket, parts, marks, dealt = at, [], [], []
            if kind == SIGNED:
                parts.append(np.frombuffer(block, SIGNATURE))
            elif kind == MARKS:
                marks.append(np.frombuffer(block, U))
            elif kind == DOCS:
                d = np.frombuffer(block, DOCUMENT)
                yield rows(DOCS, len(d), a=pa.array(np.ascontiguousarray(d["id"]), mask=d["null"]), b=d["text"], c=d["node"], n=d["n"])
            elif kind == DEALT:
                dealt.append(np.frombuffer(block, PAIR))
            else:
                head = np.frombuffer(block[:16], np.int64)
                yield rows(SKETCH, 1, c=head[:1], n=head[1:], sketch=pa.array([bytes(block[16:])], pa.binary()))
    yield from close(parts, marks, dealt)


def set_blocks(spec: Spec, bitmap):
    """The sets of the nodes that the bitmap may hold, one of each in a batch: (node, n, features as 8-byte numbers)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            for a, b, data, bounds in kernel.texts(batch.column(0)):
                text, value = kernel.shingles(kernel.split(data, bounds), spec.n)
                sizes, node = kernel.set_keys(text, value, b - a)
                low = node & U(8 * len(bits) - 1)
                want = (bits[(low >> U(3)).astype(np.int64)] >> (low & U(7)).astype(np.uint8)) & 1 > 0
                first = np.searchsorted(text, np.arange(b - a + 1))
                _, one = np.unique(node, return_index=True)
                one = one[want[one] & (sizes[one] > 0)]
                if len(one):
                    blobs = pa.array([value[first[i] : first[i + 1]].tobytes() for i in one.tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([signed(node[one]), pa.array(sizes[one]), blobs], ["node", "n", "data"])

    return run


def near(n: np.ndarray, data: list[bytes], percent: int) -> np.ndarray:
    """The tree of every set under near sketches: sets differ in as many features as their sketches in bits, or more."""
    least = min(map(len, data))
    bits = np.empty((len(n), least // 8), U)
    for i, x in enumerate(data):
        row = np.frombuffer(x, U)
        while len(row) * 8 > least:  # half as many slots
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        bits[i] = row
    tree, left, queue = np.arange(len(n)), np.arange(len(n)), []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        i = queue.pop()
        apart = np.bitwise_count(bits[left] ^ bits[i]).sum(1, dtype=np.int64)
        hit = apart * (100 + percent) <= (100 - percent) * (n[left] + n[i])
        tree[left[hit]] = tree[i]
        queue.extend(left[hit].tolist())
        left = left[~hit]
    return tree


def forest(n: np.ndarray, data: list[bytes], percent: int) -> np.ndarray:
    """The tree of every set under links within the list, all of which are found: overlap counts, no candidates."""
    m, size = len(n), n
    tree = np.arange(m)
    ids = np.unique(np.frombuffer(b"".join(data), U), return_inverse=True)[1]
    first = np.r_[0, np.cumsum(size)]
    flag = np.zeros(int(ids.max()) + 1, bool)
    left = np.arange(m)  # sets that no other has reached yet
    flat, cuts = ids, first[:-1]
    gone = np.zeros(m, bool)
    queue: list[int] = []
    while True:
        if not queue:
            rest = left[~gone[left]]
            if not len(rest):
                return tree
            queue.append(int(rest[0]))
            gone[rest[0]] = True
        v = queue.pop()
        if 2 * (~gone[left]).sum() <= len(left):  # drop those that are reached
            left = left[~gone[left]]
            if len(left):
                flat = np.concatenate([ids[first[i] : first[i + 1]] for i in left.tolist()])
                cuts = np.r_[0, np.cumsum(size[left])[:-1]]
        if not len(left):
            continue
        own = ids[first[v] : first[v + 1]]
        flag[own] = True
        common = np.add.reduceat(flag[flat], cuts, dtype=np.int64)
        flag[own] = False
        hit = left[(100 * common >= percent * (size[v] + size[left] - common)) & ~gone[left]]
        gone[hit] = True
        tree[hit] = tree[v]
        queue.extend(hit.tolist())


def compare(trees_of: Callable, percent: int):
    """Rows (root, p, q, node, n, data) sorted by task (root, p, q) -> an edge from every set to the least of its tree."""

    def close(batches: list) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        node, one = np.unique(np.asarray(t["node"]), return_index=True)  # the hubs of a block may be sets of it
        if len(one) < 2:
            return
        tree = trees_of(np.asarray(t["n"])[one], t["data"].take(pa.array(one)).to_pylist(), percent)
        least = np.full(len(one), len(one))
        np.minimum.at(least, tree, np.arange(len(one)))
        a, b = node, node[least[tree]]
        if (a != b).any():
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(i), np.int64) for i in range(3)])
            cuts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0), True]) if batch.num_rows else []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[:, x])
                if key != task:
                    if held:
                        yield from close(held)
                    task, held = key, []
                held.append(batch.slice(x, y - x))
        if held:
            yield from close(held)

    return run


def trees(members: DataFrame, data: DataFrame, kind: Callable, percent: int, most: int) -> tuple[DataFrame, bool]:
    """Edges (a, b) that connect what ``kind`` connects within a root, and whether trees of a root may still have to meet.

    members: root, node, weight. data: node, n, data. A root of at most ``most`` in weight is one task. A larger one is
    cut into blocks; the HUBS sets of least hash go to every block too. Sets that are in one component then need no more
    comparing, whichever block they are in. What is outside of the root's largest component is cut into blocks again,
    and every such block meets every block of the root. So all pairs of sets of different components are compared.
    """
    spark = members.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def compared(work: DataFrame) -> DataFrame:
        work = work.select("root", "p", "q", "node", "n", "data").repartition(partitions, "root", "p", "q").sortWithinPartitions("root", "p", "q")
        return settle(work.mapInArrow(trimmed(compare(kind, percent)), "a long, b long"))

    weights = members.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("weight").alias("weights"))
    weights = weights.filter("m > 1").select("root", F.ceil(F.col("weights") / most).cast("int").alias("blocks"))
    large = settle(weights.filter("blocks > 1"))
    if not large.head(1):
        return compared(members.select("root", "node").join(data, "node").withColumns({"p": F.lit(0), "q": F.lit(0)})), False
    held = members.join(weights, "root").withColumn("q", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(data, "node")
    held = stored(held.select("root", "node", "weight", "blocks", "q", "n", "data"), "blocks")
    least = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), F.col("node").alias("node"))).alias(f"h{i}") for i in range(HUBS)]
    hubs = held.filter("blocks > 1").groupBy("root").agg(*least)
    hubs = hubs.select("root", F.explode(F.array(*[F.col(f"h{i}.node") for i in range(HUBS)])).alias("node")).distinct()
    hubs = held.join(hubs, ["root", "node"], "left_semi").filter("blocks > 1").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    edges = compared(held.withColumn("p", F.lit(-1)).unionByName(hubs.withColumn("p", F.lit(-1))))
    named = held.filter("blocks > 1").select("root", "node", "weight").join(components(edges).select("node", F.col("root").alias("tree")), "node", "left")
    named = settle(named.withColumn("tree", F.coalesce("tree", "node")))
    sums = named.groupBy("root", "tree").agg(F.sum("weight").alias("w"))
    top = sums.groupBy("root").agg(F.max(F.struct("w", "tree")).alias("top"), F.sum("w").alias("all"))
    top = top.select("root", F.col("top.tree").alias("largest"), F.ceil((F.col("all") - F.col("top.w")) / most).cast("int").alias("rest"))
    top = settle(top.filter("rest > 0"))
    if not top.head(1):
        return edges, True
    outside = named.join(top, "root").filter("tree <> largest").select("root", "node", "rest")
    outside = held.join(outside, ["root", "node"]).withColumn("p", F.pmod(F.xxhash64("node", F.lit(HUBS)), F.col("rest")).cast("int"))
    outside = outside.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    others = held.join(top, "root").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("rest") - 1)))
    cols = ["root", "p", "q", "node", "n", "data"]
    return edges.union(compared(outside.select(*cols).union(others.select(*cols)))), True


def bitmap_of(nodes: DataFrame) -> bytes:
    """A bit for each low part of a node, about 16 bits a node; of bounded size, whatever the number of nodes."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * nodes.count()).bit_length()))
    low = nodes.select(F.expr(f"node & {(1 << bits) - 1}").alias("low"))
    # words of 64 bits, so that at most 2 ** (MOST_BITS - 6) rows come here
    word = low.selectExpr("shiftright(low, 6) AS at", "shiftleft(1L, CAST(low & 63 AS INT)) AS bit").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[np.asarray(word["at"], np.int64)] = np.asarray(word["bits"], np.int64)
    return out.tobytes()


def unions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, salt, sets) sorted by root and salt -> the same with one list for a root and salt, unless it is long."""

    def close(root: int, salt: int, held: list) -> Iterator[pa.RecordBatch]:
        nodes = np.unique(np.concatenate(held))
        for i in range(0, len(nodes), HELD):
            yield pa.RecordBatch.from_arrays([pa.array([root]), pa.array([salt]), pa.array([nodes[i : i + HELD]])], ["root", "salt", "sets"])

    at, held, n = None, [], 0
    for batch in batches:
        for root, salt, sets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (root, salt) != at:
                if held:
                    yield from close(*at, held)
                at, held, n = (root, salt), [], 0
            held.append(np.asarray(sets.values))
            n += len(held[-1])
            if n > HELD:  # so that memory follows the union, not the lists
                held, n = [np.unique(np.concatenate(held))], 0
    if held:
        yield from close(*at, held)


def candidates(met: DataFrame) -> DataFrame:
    """(root, node, weight): the sets of every signature that two or more share; equal groups of sets once.

    Groups of hot signatures with the same least set are joined, MERGES times, each time by another hash: two groups
    meet as probably as their sets overlap. What they hold only grows, so no two sets that share a signature come apart.
    Their sets stay in lists until the lists of a group are united, so that a set is one row under it.
    """
    groups = met.filter(F.col("kind") == GROUPS).dropDuplicates(["a", "b", "n"])
    cold = groups.select(F.xxhash64("a", "b", "n").alias("root"), F.explode("sets").alias("node"))
    dealt = met.filter(F.col("kind") == DEALT).select(F.col("a").alias("sig"), F.col("c").alias("salt"), "sets")
    least = [F.min(F.expr(f"array_min(transform(sets, x -> xxhash64(x, {i})))")).alias(f"least{i}") for i in range(MERGES)]
    named = dealt.groupBy("sig").agg(*least).withColumn("root", F.col("least0"))
    for i in range(1, MERGES):
        named = named.withColumn("root", F.min(f"least{i}").over(Window.partitionBy("root")))
    named = settle(named.select("sig", F.xxhash64(F.lit("hot"), "root").alias("root")))
    partitions = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = dealt.join(named, "sig").select("root", "salt", "sets")
    lists = lists.sortWithinPartitions("root", "salt").mapInArrow(trimmed(unions), lists.schema)  # before the exchange and after it
    lists = lists.repartition(partitions, "root", "salt").sortWithinPartitions("root", "salt").mapInArrow(trimmed(unions), lists.schema)
    return stored(cold.union(lists.select("root", F.explode("sets").alias("node"))).withColumn("weight", F.lit(1)), "candidates")


def grouped(docs: DataFrame, spec: Spec, id_col: str, text_col: str, features: int = FEATURES, sketches: int = SKETCHES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, node, n) of every row, and (node, root) of every set that has links to others."""
    spark = docs.sparkSession
    ship(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    packed = rows.mapInArrow(trimmed(emitter(spec, 8 * partitions)), "bucket int, kind int, block binary")
    met = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(gather), GATHERED)
    met = stored(met, "signatures")
    own = met.filter(F.col("kind") == DOCS).select(F.col("a").alias("doc_id"), F.col("b").alias("text_hash"), F.col("c").alias("node"), "n")
    shapes = met.filter(F.col("kind") == SKETCH).groupBy(F.col("c").alias("node")).agg(F.max("n").alias("n"), F.max("sketch").alias("data"))
    maybe, _ = trees(candidates(met), shapes, near, spec.percent, sketches)
    clusters = components(maybe).join(own.groupBy("node").agg(F.max("n").alias("weight")), "node")
    clusters = settle(clusters.select("root", "node", "weight"))
    bitmap = spark.sparkContext.broadcast(bitmap_of(clusters))
    sets = rows.select("text").mapInArrow(trimmed(set_blocks(spec, bitmap)), "node long, n long, data binary")
    sets = sets.groupBy("node").agg(F.max("n").alias("n"), F.first("data").alias("data"))  # copies become one before and after the exchange
    links, open_ = trees(clusters, sets, forest, spec.percent, features)
    return own, components(links) if open_ else links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def linked(docs: DataFrame, spec: Spec, id_col: str = "doc_id", text_col: str = "text", features: int = FEATURES, sketches: int = SKETCHES) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are compared after A-Z are lower-cased. A text with fewer words than a shingle has its whole sequence as one;
    null texts and texts without words have no shingles and link with nothing. component_id is the smallest identifier
    that links reach, the own one included; null identifiers are never it unless all are. Rows that repeat an
    identifier are rows of their own. Long texts are read whole. Other columns, whatever their names, are not read. An
    empty table gives an empty result.
    """
    own, groups = grouped(docs, spec, id_col, text_col, features, sketches)
    classes = own.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = classes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("node", "root").join(least, "root").select("node", "component_id")
    out = own.join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_dedup(docs: DataFrame, spec: Spec | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay: of each component the row with the smallest identifier, with all columns.

    Identifiers may be null (never kept if the component has another) or repeated: rows of one component with the
    smallest identifier but different texts are told apart by a hash of the text, and of rows that repeat both one
    stays. Null texts and texts without words link with nothing and all stay, repeated or not. Columns of any name are
    passed on. An empty table gives an empty result.
    """
    own, groups = grouped(docs, spec or Spec(), id_col, text_col)
    own = own.filter("n > 0").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rank = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id"), F.col("text_hash"))
    rows = settle(own.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times")))  # copies with other identifiers stay apart
    first = rows.groupBy("root").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("k"), F.max("times").alias("t")).filter("k > 1 OR t > 1")
    judged = salted(rows, first.select("root", "first"), "root", ["doc_id", "text_hash"]).withColumn("stays", same(F.col("doc_id"), F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
    judged = settle(judged.filter("NOT stays OR times > 1").select("doc_id", "text_hash", "stays"))
    return only_kept(docs, [docs[id_col].cast("long"), F.xxhash64(docs[text_col])], judged)


#: linked() with Spec(4, 85) over documents whose identifiers differ.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 85 * (len(sa.sh) + len(sb.sh) - n)),
l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT s.doc_id, len(s.sh) AS n_shingles, c.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id
"""
