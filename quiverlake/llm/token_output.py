"""Token-id files: bit- or byte-plane shuffled blocks, each plane compressed with zstandard, behind a chunk index.

A shard file holds the ids of a contiguous range of documents::

    "QLT2" | plane blobs and document blocks ... | footer (zstandard) | footer length u64 | "QLT2"

The footer (JSON) has one entry a chunk - offset of its first plane, number of
ids, and each plane's compressed size (0: all zero, not stored) - and one entry a
document block: offset, number of documents and compressed size. A document block
has the ids, null flags and lengths of up to ``DOC_BLOCK`` documents. Every chunk
but the last has ``block`` ids, so id i of a shard lies in chunk ``i // block`` and
a reader touches only the chunks it needs. Neither writer nor reader holds more
than a chunk, a document block and the index.

Write: documents are range-partitioned and sorted by the order columns, one
shard a task, as many shards as their bytes ask for (``SHARD_BYTES``, and as many
as shuffle partitions at least), written under a name of its own attempt and listed
in a table of shards, so a repeated task leaves at most an unlisted file. Read: one
task a shard, a chunk in memory at a time.

Defined cases: a null or empty text is the end id alone; a very long text is encoded
in slices at white space (whole only where it has white space beyond ASCII, which the
tokenizer may join across slices); equal order keys are ordered by text; a null
doc_id sorts first; repeated rows are written as often as they come; an empty table
gives no shards and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import SPACES, arrow_map, fs_of, n_parts, pieces, scratch_path, stage

MAGIC = b"QLT2"
DOC_BLOCK = 8192
SHARD_BYTES = 256 << 20  # of text a shard
SLICE = 1 << 21  # characters of a very long text at a time

# ------------------------------------------------------------------- planes


def to_planes(ids: np.ndarray, mode: str = "byte") -> list[bytes]:
    """32-bit ids as 4 byte planes or 32 bit planes, least significant first."""
    le = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [le[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(le, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes | None], n: int, mode: str = "byte") -> np.ndarray:
    if mode == "byte":
        le = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p is not None:
                le[:, k] = np.frombuffer(p, np.uint8)
        return le.view("<u4").ravel()
    bits = np.zeros((n, 32), np.uint8)
    for k, p in enumerate(planes):
        if p is not None:
            bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


class ShardWriter:
    def __init__(self, out, block: int = 1 << 16, mode: str = "byte", level: int = 1, doc_block: int = DOC_BLOCK):
        self.out, self.block, self.mode, self.doc_block = out, block, mode, doc_block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.rest: list[np.ndarray] = []
        self.n_rest = self.n_ids = self.n_docs = 0
        self.chunks: list[list] = []
        self.docs: list[list] = []
        self.held: list[tuple] = []
        out.write(MAGIC)
        self.at = len(MAGIC)

    def _put(self, blob: bytes) -> int:
        self.out.write(blob)
        self.at += len(blob)
        return len(blob)

    def _chunk(self, ids: np.ndarray) -> None:
        start = self.at
        sizes = [self._put(self.zip.compress(plane)) if plane.strip(b"\0") else 0 for plane in to_planes(ids, self.mode)]
        self.chunks.append([start, len(ids), sizes])

    def _docs(self) -> None:
        own, self.held = self.held[: self.doc_block], self.held[self.doc_block :]
        ids, null, n = np.array([d or 0 for d, _ in own], "<i8"), np.array([d is None for d, _ in own], np.uint8), np.array([n for _, n in own], "<i8")
        start = self.at
        self.docs.append([start, len(own), self._put(self.zip.compress(ids.tobytes() + null.tobytes() + n.tobytes()))])

    def write(self, ids: np.ndarray) -> None:
        """Ids of the documents that ``end`` lists next."""
        self.rest.append(ids)
        self.n_rest += len(ids)
        self.n_ids += len(ids)
        if self.n_rest >= self.block:
            whole = np.concatenate(self.rest)
            cut = len(whole) // self.block * self.block
            for i in range(0, cut, self.block):
                self._chunk(whole[i : i + self.block])
            self.rest, self.n_rest = [whole[cut:].copy()], len(whole) - cut

    def end(self, doc_ids: list, lengths: list[int]) -> None:
        self.held += zip(doc_ids, lengths)
        self.n_docs += len(doc_ids)
        while len(self.held) >= self.doc_block:
            self._docs()

    def add(self, doc_ids: list, lengths: list[int], ids: np.ndarray) -> None:
        self.write(ids)
        self.end(doc_ids, lengths)

    def close(self) -> None:
        if self.n_rest:
            self._chunk(np.concatenate(self.rest))
        if self.held:
            self._docs()
        foot = self.zip.compress(json.dumps({"block": self.block, "mode": self.mode, "chunks": self.chunks, "docs": self.docs}).encode())
        self.out.write(foot + struct.pack("<Q", len(foot)) + MAGIC)


class ShardReader:
    """Random access by the chunk index; source: a file object that can seek."""

    def __init__(self, source, size: int):
        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        source.seek(size - 12)
        n, magic = struct.unpack("<Q4s", source.read(12))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        source.seek(size - 12 - n)
        foot = json.loads(self.unzip.decompress(source.read(n)))
        self.block, self.mode, self.chunks, self.docs = (foot[k] for k in ("block", "mode", "chunks", "docs"))

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.chunks[k]
        self.source.seek(at)
        planes = [self.unzip.decompress(self.source.read(s)) if s else None for s in sizes]
        return from_planes(planes, n, self.mode)

    def documents(self) -> Iterator[tuple[int | None, int]]:
        """(doc_id, number of ids) of each document, a block in memory at a time."""
        for at, n, size in self.docs:
            self.source.seek(at)
            raw = self.unzip.decompress(self.source.read(size))
            ids, null, lengths = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n), np.frombuffer(raw, "<i8", n, 9 * n)
            yield from ((None if x else d, c) for d, x, c in zip(ids.tolist(), null.tolist(), lengths.tolist()))

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start:end of the shard, from the chunks that hold them."""
        if end <= start:
            return np.zeros(0, "<u4")
        a, b = start // self.block, (end - 1) // self.block
        return np.concatenate([self.chunk(k) for k in range(a, b + 1)])[start - a * self.block : end - a * self.block]


# ----------------------------------------------------------------- encoding

#: A run of ASCII white space and the letters after it, if an ASCII character that is
#: no letter comes next, else all up to the next white space. The tokenizer's own
#: pre-tokens never cross the start of such a unit, so units can be encoded alone.
UNIT = re.compile(r"[ \t-\r]*[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\x00-\x7f])|[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: White space beyond that; a document that has any is encoded in one piece.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　]")


class Places(dict):
    """unit -> place; an unknown unit gets the next place, and is listed in ``new``."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.new.append(unit)
        return n


_tokenizers: dict[str, tuple] = {}


def tokenizer_of(path: str) -> tuple:
    """A tokenizer and the number of bytes of each id, loaded once a Python worker (each load costs time and some memory that doesn't come back)."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab()
        n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            n_bytes[i] = len(token)
        _tokenizers[path] = tokenizer, n_bytes
    return _tokenizers[path]


class Encoder:
    """The tokenizers library over distinct units, with a bounded cache of them."""

    def __init__(self, path: str, cache: int = 500_000):
        (self.tokenizer, self.n_bytes), self.limit = tokenizer_of(path), cache
        self.clear()

    def clear(self) -> None:
        self.place = Places()
        self.flat = np.zeros(0, "<u4")
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def one_by_one(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((x for g in got for x in g), "<u4", int(size.sum())), size

    def joined(self, new: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The units' ids from texts of many units each: a byte-level id stands for a known number of bytes, which tells where units end. None where they end within an id."""
        texts = ["".join(new[i : i + 100]) for i in range(0, len(new), 100)]  # longer texts take the library longer a unit
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.cumsum(self.n_bytes[ids])
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        char = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where characters begin
        want = char[np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))]
        at = np.searchsorted(ends, want)
        if len(ends) == 0 or ends[-1] != want[-1] or (ends[at] != want).any():
            return None
        return ids, np.diff(at, prepend=-1)

    def learn(self, new: list[str]) -> None:
        # a unit that starts with white space and doesn't end with any can stand after another
        inner = [u for u in new if u[:1] in SPACES and u[-1:] not in SPACES]
        got = self.joined(inner) if inner else None
        if got is None:
            inner, got = [], (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        known = set(inner)
        alone = [u for u in new if u not in known] if len(known) < len(new) else []
        flat, size = (np.concatenate(x) for x in zip(got, self.one_by_one(alone)))
        start = len(self.flat) + np.cumsum(size) - size
        if alone:  # back to the order of the places
            at = {u: k for k, u in enumerate(inner + alone)}
            order = np.fromiter(map(at.__getitem__, new), np.int64, len(new))
            start, size = start[order], size[order]
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[str], end: int | None = 0) -> tuple[np.ndarray, list[int]]:
        """All ids, document by document with the end id, and the documents' lengths."""
        units: list[str] = []
        counts = []
        for t in texts:
            own = [t] if OTHER_SPACE.search(t) else UNIT.findall(t)
            units += own
            counts.append(len(own))
        if len(self.place) > self.limit:
            self.clear()
        at = np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))
        if self.place.new:
            self.learn(self.place.new)
            self.place.new = []
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(total)]
        cut = np.cumsum(np.asarray(counts, np.int64))
        doc_end = np.concatenate([[0], ends])[cut]
        lengths = np.diff(np.concatenate([[0], doc_end]))
        if end is not None:
            ids, lengths = np.insert(ids, doc_end, end), lengths + 1
        return ids.astype("<u4"), lengths.tolist()


    def slices(self, text: str, end: int | None = 0) -> Iterator[np.ndarray]:
        """The ids of a very long text, slice by slice: a run of white space after another character always begins a unit."""
        if OTHER_SPACE.search(text):
            yield self.encode([text], end)[0]
            return
        at = 0
        while at < len(text):
            cut = BREAK.search(text, at + SLICE)
            to = cut.start() + 1 if cut else len(text)
            yield self.encode([text[at:to]], None)[0]
            at = to
        if end is not None:
            yield np.array([end], "<u4")


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """An encoder with the units that this Python worker's earlier tasks have met (a bounded number)."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


#: The last character before white space.
BREAK = re.compile(r"[^ \t-\r](?=[ \t-\r])")


# ---------------------------------------------------------------- operators

SHARDS = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])


def write_tokens(docs: DataFrame, tokenizer: str, out: str | None = None, order: tuple[str, ...] = ("doc_id",), text: str = "text", doc_id: str = "doc_id", end: int = 0, block: int = 1 << 16, mode: str = "byte", level: int = 1) -> DataFrame:
    """Write the shards under ``out`` (by default a new folder on the shared folder); returns the table of shards."""
    spark = docs.sparkSession
    out = out or scratch_path(spark, "tokens")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = max(n_parts(spark), -(-size // SHARD_BYTES))
    rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "_text").select("_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, folder = fs_of(out)
        path = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.qlt"
        writer = None
        for b in pieces(batches, "_text", 4 << 20):
            if writer is None:
                fs.create_dir(folder, recursive=True)
                sink = fs.open_output_stream(path)
                writer, encoder = ShardWriter(sink, block, mode, level), encoder_of(tokenizer)
            texts = [x or "" for x in b.column(1).to_pylist()]
            if len(texts) == 1 and len(texts[0]) > 2 * SLICE:
                before = writer.n_ids
                for ids in encoder.slices(texts[0], end):
                    writer.write(ids)
                writer.end(b.column(0).to_pylist(), [writer.n_ids - before])
            else:
                ids, lengths = encoder.encode(texts, end)
                writer.add(b.column(0).to_pylist(), lengths, ids)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([path]), pa.array([writer.n_docs], pa.int64()), pa.array([writer.n_ids], pa.int64())], ["shard", "path", "n_docs", "n_ids"])

    listed = arrow_map(rows, run, SHARDS).withColumn("path", F.concat(F.lit(f"{out}/"), F.element_at(F.split("path", "/"), -1)))
    return stage(listed, "shards")


def read_tokens(shards: DataFrame, each: Callable, schema: T.StructType) -> DataFrame:
    """Read the shards back. each(doc_id, start, chunks) gets a document's ids as an iterable of arrays and returns a row."""
    first = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a shard
    listed = shards.select("shard", "path", first.alias("first"))
    # a number of partitions is kept as it is: the few rows of the list would else be merged into one task
    listed = listed.repartitionByRange(max(1, shards.count()), "shard")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                fs, path = fs_of(row["path"])
                with fs.open_input_file(path) as f:
                    r = ShardReader(f, fs.get_file_info(path).size)
                    k, at, chunk, done, out = 0, 0, np.zeros(0, "<u4"), 0, []

                    def take(n: int) -> Iterator[np.ndarray]:
                        nonlocal k, at, chunk
                        while n:
                            if at == len(chunk):
                                chunk, at, k = r.chunk(k), 0, k + 1  # noqa: B023
                            part = chunk[at : at + n]
                            at += len(part)
                            n -= len(part)
                            yield part

                    for d, n in r.documents():
                        out.append(each(d, row["first"] + done, take(n)))
                        done += n
                        if len(out) == 5000:
                            yield pa.RecordBatch.from_pylist(out, schema=arrow)
                            out = []
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return arrow_map(listed, run, schema)


DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def digest(doc_id: int, start: int, chunks) -> dict:
    """doc_id, start, n_tokens and the crc32 of a document's ids."""
    crc, n = 0, 0
    for c in chunks:
        crc, n = zlib.crc32(c.tobytes(), crc), n + len(c)
    return {"doc_id": doc_id, "start": start, "n_tokens": n, "ids_crc32": crc}


def token_output(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write docs as token shards and return the digest of each document as read back."""
    return read_tokens(write_tokens(docs, tokenizer, **options), digest, DIGEST)


def in_file_order(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """docs with columns that give the order of the rows in the files they were read from, and those columns; by doc_id where there are no files."""
    try:
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        part = F.regexp_extract(name, r"part-(\d+)", 1).try_cast("bigint")
        placed = docs.select("*", part.alias("_ql_part"), name.alias("_ql_file"), F.col("_metadata.row_index").alias("_ql_row"))
        placed.schema  # noqa: B018  analysed now
        return placed, ("_ql_part", "_ql_file", "_ql_row")
    except AnalysisException:
        return docs, ("doc_id",)
