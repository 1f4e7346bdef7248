"""Shared helpers: scratch tables on the shared folder, Arrow text kernels."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Whitespace of the word contract: 0x20 and 0x09-0x0D.
SPACES = " \t\n\x0b\x0c\r"

_MASK64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only where it is unset and there is one machine (tests), a new temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quiverlake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ql-{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Writes inside delete their shuffle files at their end; else those stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_deleted(spark):
        df.write.parquet(path, compression=compression)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


@contextlib.contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """Collects the paths of the scratch tables made inside, for ``delete`` once what is made of them is written."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


def delete(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables of which everything has been read into later ones."""
    for t in tables:
        delete(t.sparkSession, t._scratch)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---------------------------------------------------------------- text kernel


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer over uint64 values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


#: A random 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i < n."""
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        for k, b in enumerate((_BASE, _INV)):
            a = np.full(m, b, U64)
            a[0] = 1
            _powers[k] = np.cumprod(a)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[j]-P[i] the (unshifted) polynomial hash of buf[i:j]."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(BYTE_VALUES[buf] * powers(len(buf))[0], out=out[1:])
    return out


def slice_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[starts:ends] that depend on the bytes only."""
    inv = powers(len(p))[1]
    return mix((p[ends] - p[starts]) * inv[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty), and the documents' offsets in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


SLICE = 4 << 20  # bytes of text whose words are found at a time


def word_slices(buf: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of about SLICE bytes that end before white space."""
    out, at = [], 0
    while len(buf) - at > 2 * SLICE:
        to = at + SLICE
        while to < len(buf):
            gap = np.flatnonzero(IS_SPACE[buf[to : to + SLICE]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(len(buf), to + SLICE)
        out.append((at, to))
        at = to
    return [*out, (at, len(buf))]


class Words:
    """Lower-cased (A-Z) words of a batch of documents: hashes, byte ranges, and each document's word range.

    A very long text is read in slices, so that what is held of it is some numbers a
    word and not some a byte.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.offsets = offsets
        found = [self._words(buf[a:b], offsets[(offsets >= a) & (offsets <= b)] - a, a) for a, b in word_slices(buf)]
        self.starts, self.ends, self.hashes = (np.concatenate(x) if len(found) > 1 else x[0] for x in zip(*found))
        self.first = np.searchsorted(self.starts, offsets)  # word range of document d: first[d]:first[d+1]

    @staticmethod
    def _words(buf: np.ndarray, offsets: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(buf)
        word = ~IS_SPACE[buf]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        starts = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        return starts + base, ends + base, slice_hash(prefix_hash(LOWER[buf]), starts, ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, document by document, their documents and first words. A document of fewer words has its whole sequence as one."""
        h, n, first = self.hashes, self.counts(), self.first
        m = len(h)
        s = np.zeros(m, U64)
        for j in range(k):
            if m > j:
                s[: m - j] = s[: m - j] * U64(_BASE) + h[j:]
        doc = self.doc_of_word()
        at = np.arange(m)
        keep = at + k <= first[doc + 1]
        s, d, at = s[keep], doc[keep], at[keep]
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            own = np.zeros(len(short), U64)
            for j in range(k - 1):
                has = n[short] > j
                own[has] = own[has] * U64(_BASE) + h[first[short[has]] + j]
            own += n[short].astype(U64) * U64(0xC2B2AE3D27D4EB4F)
            s, d, at = np.concatenate([s, own]), np.concatenate([d, short]), np.concatenate([at, first[short]])
            order = np.argsort(d, kind="stable")
            s, d, at = s[order], d[order], at[order]
        return mix(s), d, at


BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20  # rows of scratch tables are some MB each; a row is never cut


def tidy() -> None:
    """Give memory back to the system: Spark keeps a task's Python worker for later tasks."""
    _powers[:] = [np.ones(1, U64), np.ones(1, U64)]
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, function: Callable, schema) -> DataFrame:
    """mapInArrow with batches of at most BATCH_ROWS rows and about BATCH_BYTES (texts can be long) and workers that end up small.

    The session's settings are read when a plan runs, so they are lowered for good.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from function(batches)
        finally:
            tidy()

    return df.mapInArrow(run, schema)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of one hold about ``limit`` bytes (one document at least)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        col = b.column(b.schema.get_field_index(column))
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        part = np.cumsum(size) // limit
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [b.num_rows]])
        for i, j in zip(cuts[:-1], cuts[1:]):
            if j > i:
                yield b.slice(i, j - i)


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def fs_of(uri: str):
    """A pyarrow filesystem and the path in it, for files on the shared folder."""
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def public_vocabulary(name: str) -> str:
    """The path of an installed public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
