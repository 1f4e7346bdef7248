"""Binary vector files as Spark sources and sinks.

Formats: fvecs, bvecs, ivecs (a dimension before each row), and bin with an
explicit layout: header32 (eight 32-bit numbers: rows, dimension, element type
0..3, five reserved), header8 (rows, dimension, then float32) or raw (float32, the
dimension is an option). A file is split into ranges of rows. Reading gives
``pos bigint`` (the place in its file), ``vec``, ``file`` and ``id bigint`` (the place in
all files in the order of their names).

    spark.dataSource.register(VectorFiles)
    spark.read.format("vectors").option("format", "fvecs").load("file:///data/base.fvecs")
    rows.select("vec").write.format("vectors").option("format", "bin").option("layout", "header32").option("dtype", "int8").save("/out")
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed values of the formats: element types by their number in header32.
TYPES = ("<f4", "<f2", "i1", "u1")
NAMES = {"float32": 0, "float": 0, "f32": 0, "float16": 1, "f16": 1, "int8": 2, "i8": 2, "uint8": 3, "u8": 3}
ROW_TYPES = {"fvecs": "<f4", "bvecs": "u1", "ivecs": "<i4"}
EXTENSIONS = (*ROW_TYPES, "bin")
RANGE_BYTES = 64 << 20


def detect(path: str) -> str:
    """The format by the file's extension."""
    ext = path.rsplit(".", 1)[-1].lower()
    if ext not in EXTENSIONS:
        raise ValueError(f"a vector file ends in {', '.join(EXTENSIONS)}")
    return ext


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Shape:
    """Where rows are in a file: bytes before the first, bytes of a row, bytes before its elements, type, dimension, rows."""

    start: int
    stride: int
    skip: int
    kind: str
    dimension: int
    rows: int


def shape_of(head: bytes, size: int, options: dict[str, str], path: str) -> Shape:
    form = options.get("format") or detect(path)
    if form in ROW_TYPES:
        kind = ROW_TYPES[form]
        if size == 0:
            return Shape(0, 1, 0, kind, 0, 0)
        d = struct.unpack("<I", head[:4])[0]
        stride = 4 + d * np.dtype(kind).itemsize
        if size % stride:
            raise ValueError(f"{path}: rows of more than one dimension, or a part of a row")
        return Shape(0, stride, 4, kind, d, size // stride)
    layout = options.get("layout")
    if layout == "header32":
        n, d, t = struct.unpack("<3I", head[:12])
        kind, start = TYPES[t], 32
    elif layout == "header8":
        n, d = struct.unpack("<2I", head[:8])
        kind, start = "<f4", 8
    elif layout == "raw":
        d, kind, start = int(options["dimension"]), "<f4", 0
        n = size // (4 * d)
    else:
        raise ValueError("the layout of a bin file is header32, header8 or raw")
    stride = d * np.dtype(kind).itemsize
    if size != start + n * stride:
        raise ValueError(f"{path}: the size isn't that of {n} rows of dimension {d}")
    return Shape(start, max(1, stride), 0, kind, d, n)


def decode(raw: bytes, s: Shape) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8).reshape(-1, s.stride)
    if s.skip and (rows[:, :4].copy().view("<u4").ravel() != s.dimension).any():
        raise ValueError("rows of more than one dimension")
    out = rows[:, s.skip :].copy().view(s.kind)
    return out if s.kind == "<i4" else out.astype(np.float32)


def convert(x: np.ndarray, kind: str) -> np.ndarray:
    """Integers are rounded half away from zero and held in range."""
    dtype = np.dtype(kind)
    if dtype.kind == "f":
        return x.astype(dtype)
    info = np.iinfo(dtype)
    x = x.astype(np.float64)
    return np.clip(np.sign(x) * np.floor(np.abs(x) + 0.5), info.min, info.max).astype(dtype)


def header(n: int, d: int, layout: str, dtype: str) -> bytes:
    """The first bytes of a bin file."""
    return {"header32": struct.pack("<8I", n, d, NAMES[dtype], 0, 0, 0, 0, 0), "header8": struct.pack("<2I", n, d), "raw": b""}[layout]


def encode_rows(x: np.ndarray, form: str, layout: str = "", dtype: str = "float32") -> bytes:
    """Rows without a file's header."""
    n, d = x.shape
    if form not in ROW_TYPES:
        return convert(x, TYPES[NAMES[dtype] if layout == "header32" else 0]).tobytes()
    rows = convert(x, ROW_TYPES[form])
    out = np.empty((n, 4 + d * rows.itemsize), np.uint8)
    out[:, :4] = np.frombuffer(struct.pack("<I", d), np.uint8)
    out[:, 4:] = rows.view(np.uint8).reshape(n, -1)
    return out.tobytes()


def encode(x: np.ndarray, form: str, layout: str = "", dtype: str = "float32") -> bytes:
    """A whole file."""
    return (b"" if form in ROW_TYPES else header(*x.shape, layout, dtype)) + encode_rows(x, form, layout, dtype)


class _Range(InputPartition):
    def __init__(self, path: str, shape: Shape, first: int, rows: int, before: int = 0):
        self.path, self.shape, self.first, self.rows, self.before = path, shape, first, rows, before


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as pafs

        fs, path = filesystem(self.options["path"])
        info = fs.get_file_info(path)
        files = [info] if info.type == pafs.FileType.File else sorted((f for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        out: list[InputPartition] = []
        before = 0
        for f in files:
            with fs.open_input_file(f.path) as x:
                s = shape_of(x.read(32), f.size, self.options, f.path)
            step = max(1, RANGE_BYTES // s.stride)
            out += [_Range(f.path, s, i, min(step, s.rows - i), before) for i in range(0, s.rows, step)]
            before += s.rows
        return out or [_Range("", Shape(0, 1, 0, "<f4", 0, 0), 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.options["path"])
        ints = self.options.get("format") == "ivecs" or part.shape.kind == "<i4"
        s, kind = part.shape, pa.int32() if ints else pa.float32()
        if not part.rows:
            return
        with fs.open_input_file(part.path) as x:
            for i in range(part.first, part.first + part.rows, 8192):
                n = min(8192, part.first + part.rows - i)
                x.seek(s.start + i * s.stride)
                v = decode(x.read(n * s.stride), s)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, n * s.dimension + 1, max(1, s.dimension))[: n + 1], pa.int32()), pa.array(v.ravel(), kind))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + n)), cells, pa.array([part.path.rsplit("/", 1)[-1]] * n), pa.array(np.arange(i, i + n) + part.before)], ["pos", "vec", "file", "id"])


@dataclass
class _Part(WriterCommitMessage):
    path: str
    rows: int


class _Writer(DataSourceArrowWriter):
    """One file a task; an empty task writes none."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.options, self.overwrite = options, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        form, layout, dtype = (self.options.get(k, v) for k, v in (("format", "fvecs"), ("layout", "header32"), ("dtype", "float32")))
        fs, folder = filesystem(self.options["path"])
        c = TaskContext.get()
        path = f"{folder}/part-{c.partitionId():05d}-{c.taskAttemptId()}.{form}"
        out, n, d = None, 0, 0
        for b in batches:
            v = b.column(b.schema.get_field_index("vec"))
            if not b.num_rows:
                continue
            size = np.diff(np.asarray(v.offsets))
            if out is None:
                fs.create_dir(folder, recursive=True)
                out, d = fs.open_output_stream(f"{path}.rows.tmp"), int(size[0])
            if (size != d).any():
                raise ValueError("vectors of more than one dimension")
            out.write(encode_rows(np.asarray(v.flatten()).reshape(b.num_rows, d), form, layout, dtype))
            n += b.num_rows
        if out is None:
            return _Part("", 0)
        out.close()
        if form in ROW_TYPES:
            fs.move(f"{path}.rows.tmp", f"{path}.tmp")
        else:  # the header has the number of rows, which is known now
            with fs.open_input_stream(f"{path}.rows.tmp") as rows, fs.open_output_stream(f"{path}.tmp") as f:
                f.write(header(n, d, layout, dtype))
                while part := rows.read(4 << 20):
                    f.write(part)
            fs.delete_file(f"{path}.rows.tmp")
        return _Part(path, n)

    def commit(self, messages: list) -> None:
        from pyarrow import fs as pafs

        fs, folder = filesystem(self.options["path"])
        fs.create_dir(folder, recursive=True)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if not f.path.endswith(".tmp")] if self.overwrite else []
        for m in messages:
            if m and m.path:
                fs.move(f"{m.path}.tmp", m.path)
        for p in old:
            fs.delete_file(p)

    def abort(self, messages: list) -> None:
        fs, _ = filesystem(self.options["path"])
        for m in messages:
            if m and m.path:
                fs.delete_file(f"{m.path}.tmp")


class VectorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        form = self.options.get("format") or detect(self.options["path"])
        return f"pos bigint, vec array<{'int' if form == 'ivecs' else 'float'}>, file string, id bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)
