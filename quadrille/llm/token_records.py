"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A data file is a run of records. A record is: payload length (u64), masked CRC-32 of these 8 bytes (u32), payload,
masked CRC-32 of the payload (u32), all little-endian. A payload is a header (HEADER: document id, whether it is null,
bytes per id, number of ids) and the ids as unsigned 16-bit numbers, or 32-bit ones for larger vocabularies. An index
file has one ENTRY for each record of its data file: where the record begins and how many ids it and the records before
it hold, so that a reader can fetch records in any order and knows their place in the whole stream.

Documents are dealt out by ranges of their identifier and sorted within a range; a task writes its files to the shared
folder under temporary names and renames them, so a lost or repeated task leaves whole files only. What comes to the
driver is one row a file.
"""

from __future__ import annotations

import array
import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, ship

HEADER = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("width", "u1"), ("n", "<u8")])
HEAD = struct.Struct("<qBBQ")
ENTRY = np.dtype([("offset", "<u8"), ("n", "<u8"), ("before", "<u8")])
#: A data file is closed beyond this size.
FILE_BYTES = 64 << 20
#: Words of which a worker remembers the ids.
REMEMBERED = 400_000
END = 1


def masked(data: bytes) -> int:
    """A CRC that is stored with the data it covers is masked, so that a CRC over both differs."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def payload(doc_id: int | None, width: int, ids: bytes) -> bytes:
    return HEAD.pack(doc_id or 0, doc_id is None, width, len(ids) // width) + ids


def frame(payload: bytes) -> bytes:
    length = len(payload).to_bytes(8, "little")
    return b"".join([length, masked(length).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")])


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the record at ``at``, and where the next one begins; both checksums must hold."""
    head = bytes(data[at : at + 8])
    if masked(head) != int.from_bytes(data[at + 8 : at + 12], "little"):
        raise ValueError(f"record at {at}: its length is damaged")
    end = at + 12 + int.from_bytes(head, "little")
    payload = data[at + 12 : end]
    if masked(payload) != int.from_bytes(data[end : end + 4], "little"):
        raise ValueError(f"record at {at}: its payload is damaged")
    return payload, end + 4


_encoders: dict[str, tuple] = {}


class Recent(dict):
    """A dict that makes what it lacks and drops what was not used for long: it keeps two generations."""

    def __init__(self, make: Callable[[bytes], bytes], most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: bytes) -> bytes:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


#: The steps of a vocabulary whose texts may be encoded word by word, a fixed value of its file: lower case, runs of white
#: space as one space, and a split that white space always ends.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: That split for lower-case ASCII.
ASCII_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: Parts that a byte-level vocabulary spells as they are.
AS_SPELLED = re.compile(rb"[!-~]+")


class Encoder:
    """A tokenizer. With the steps in WORDWISE and added tokens that begin with ``<|``, a text's ids are those of its words.

    Words are remembered, and ASCII words are split as the vocabulary splits them, so that their parts are, too, and go to
    the library's merges without its other steps, which would leave them as they are; all others go to the library whole. Any other vocabulary encodes every text in one piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        steps = json.loads(self.tokenizer.to_str())
        self.wordwise = all(steps[k] == v for k, v in WORDWISE.items()) and all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in steps["added_tokens"])
        self.model = self.tokenizer.model
        self.parts = Recent(self.part, 2 * REMEMBERED)
        self.words = Recent(self.word, REMEMBERED)

    def whole(self, text: bytes) -> bytes:
        return array.array(self.kind, self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def part(self, part: bytes) -> bytes:
        if not AS_SPELLED.fullmatch(part):
            return self.whole(part)
        return array.array(self.kind, [t.id for t in self.model.tokenize(part.decode())]).tobytes()

    def word(self, word: bytes) -> bytes:
        if not word.isascii() or b"<|" in word:
            return self.whole(word)
        word = word.lower()
        return b"".join(map(self.parts.__getitem__, [word] if word.isalpha() else ASCII_PARTS.findall(word)))

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian numbers of ``width`` bytes."""
        if not self.wordwise:
            return self.whole(text)
        if text.isascii() and b"<|" not in text:
            text = text.lower()
        return b"".join(map(self.words.__getitem__, text.split()))


def encoder(path: str) -> Encoder:
    """One for each worker process, which tasks share."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@dataclass
class Files:
    """Data and index files that are written side by side and closed by size."""

    folder: str
    part: int

    def __post_init__(self):
        self.fs, self.path = pafs.FileSystem.from_uri(self.folder)
        self.number, self.data = 0, None

    def open(self) -> None:
        self.name = f"part-{self.part:06d}-{self.number:05d}"
        self.temp = f"{self.path}/.{self.name}-{uuid.uuid4().hex}"
        self.data, self.size, self.ids, self.entries = self.fs.open_output_stream(self.temp + ".data"), 0, 0, []
        self.number += 1

    def add(self, payload: bytes, n: int) -> None:
        if self.data is None:
            self.open()
        record = frame(payload)
        self.entries.append((self.size, n, self.ids))
        self.data.write(record)
        self.size += len(record)
        self.ids += n

    def close(self) -> tuple[str, int, int, int]:
        self.data.close()
        with self.fs.open_output_stream(self.temp + ".index") as f:
            f.write(np.array(self.entries, ENTRY).tobytes())
        for kind in ("index", "data"):
            self.fs.move(f"{self.temp}.{kind}", f"{self.path}/{self.name}.{kind}")
        self.data = None
        return self.name, len(self.entries), self.ids, self.size


def write(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int | None = END, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> tuple[str, list]:
    """Writes all documents in ascending order of identifier; returns the folder and (file, records, ids) in that order.

    Null texts count as empty: only the end id. Null identifiers come first. Rows that share an identifier are ordered
    by a hash of their texts; repeated rows are written each. Long texts are encoded whole. Other columns, whatever their
    names, are not read. An empty table gives no files.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or shared_folder(spark, "records")
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = b"" if end_id is None else end_id.to_bytes(enc.width, "little")
        files, done = Files(folder, TaskContext.get().partitionId()), []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids = enc.encode(text.as_py() or b"") + end
                n = len(ids) // enc.width
                files.add(payload(doc_id, enc.width, ids), n)
                if files.size >= file_bytes:
                    done.append(files.close())
        if files.data is not None:
            done.append(files.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["file", "records", "ids", "bytes"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    got = rows.mapInArrow(run, "file string, records long, ids long, bytes long").collect()  # one row a file
    return folder, sorted((r["file"], r["records"], r["ids"]) for r in got)


def records(folder: str, name: str, order: Iterable[int] | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """(ids before it in the file, document id, ids) of a file's records in the given order, by the index."""
    fs, path = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{path}/{name}.index") as f:
        index = np.frombuffer(f.read(), ENTRY)
    with fs.open_input_file(f"{path}/{name}.data") as f:
        data = memoryview(f.read_buffer(f.size()))  # a file is bounded by FILE_BYTES and one record
    for i in range(len(index)) if order is None else order:
        payload, _ = unframe(data, int(index["offset"][i]))
        head = np.frombuffer(payload[: HEADER.itemsize], HEADER)[0]
        ids = np.frombuffer(payload[HEADER.itemsize :], f"<u{head['width']}")
        if len(ids) != head["n"] or head["n"] != index["n"][i]:
            raise ValueError(f"{name}, record {i}: index and record differ")
        yield int(index["before"][i]), None if head["null"] else int(head["doc_id"]), ids


def read(spark: SparkSession, folder: str, files: list, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every record, each file in a shuffled order.

    Null identifiers are null again; repeated rows are records of their own; no files give an empty result. A record whose
    checksums don't hold raises.
    """
    ship(spark)
    starts = np.cumsum([0, *[ids for _, _, ids in files]]).tolist()
    todo = [(name, start) for (name, _, _), start in zip(files, starts[:-1], strict=True)]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = pafs.FileSystem.from_uri(folder)
                n = fs.get_file_info(f"{path}/{name}.index").size // ENTRY.itemsize
                order = np.random.default_rng(zlib.crc32(name.encode())).permutation(n)
                found = records(folder, name, order)
                while rows := [(d, base + before, len(x), zlib.crc32(x.astype("<u4").tobytes()), *([x.astype(np.int64)] if with_ids else [])) for before, d, x in itertools.islice(found, 4096)]:
                    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    parts = max(1, min(len(todo), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.createDataFrame(todo, "file string, base long").repartition(parts).mapInArrow(run, schema)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return read(docs.sparkSession, *write(docs, vocabulary or vocabulary_path()))
