"""Product quantization: training, encoding, decoding, asymmetric and symmetric distances, two-stage search.

A codebook is M x K centroids of d / M elements: bounded by its parameters, so it
is a literal or a broadcast array. Codes are array<int>.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from .kmeans import ELEMENTS, nearest
from .knn import matrix, query_blocks, ranked


@dataclass(frozen=True)
class Params:
    dimension: int
    m: int = 8
    bits: int = 8
    rounds: int = 25
    seed: int = 42

    def __post_init__(self) -> None:
        if self.m < 1 or self.dimension % self.m:
            raise ValueError("the dimension isn't a multiple of m")
        if not 1 <= self.bits <= 16:
            raise ValueError("bits is from 1 to 16")

    @property
    def width(self) -> int:
        return self.dimension // self.m

    @property
    def k(self) -> int:
        return 1 << self.bits

    def stats(self) -> dict[str, float]:
        return {"ratio": 4 * self.dimension / (self.m * (1 if self.bits <= 8 else 2)), "codebook_bytes": 4.0 * self.k * self.dimension, "table_bytes": 4.0 * self.m * self.k * self.k}


#: Terms of symmetric distances that are broadcast at most (16 bytes each and the overhead of a hashed row).
MAX_TERMS = 600_000
PRESET_8X8, PRESET_16X8 = (8, 8), (16, 8)


def table(spark, codebook: np.ndarray) -> DataFrame:
    """subspace, code, centroid rows of a codebook."""
    m, k, _ = codebook.shape
    return spark.createDataFrame([(i, j, codebook[i, j].tolist()) for i in range(m) for j in range(k)], "subspace int, code int, centroid array<double>")


def array(rows: DataFrame) -> np.ndarray:
    """The codebook of subspace, code, centroid rows."""
    got = sorted(map(tuple, rows.select("subspace", "code", "centroid").collect()))
    m, k = 1 + max(r[0] for r in got), 1 + max(r[1] for r in got)
    return np.array([r[2] for r in got]).reshape(m, k, -1)


def to_json(codebook: np.ndarray, p: Params) -> str:
    """The codebook and its parameters as JSON."""
    return json.dumps({"dimension": p.dimension, "m": p.m, "bits": p.bits, "rounds": p.rounds, "seed": p.seed, "centroids": codebook.tolist()})


def from_json(text: str) -> tuple[np.ndarray, Params]:
    d = json.loads(text)
    p = Params(d["dimension"], d["m"], d["bits"], d["rounds"], d["seed"])
    book = np.array(d["centroids"], float)
    if book.shape != (p.m, p.k, p.width):
        raise ValueError("the centroids don't have the shape of the parameters")
    return book, p


def lookup(rows: DataFrame, subspace: int, code: int) -> DataFrame:
    """The centroid of a code: no row if there is none."""
    return rows.where((F.col("subspace") == subspace) & (F.col("code") == code)).select("centroid")


def validate(rows: DataFrame, m: int, k: int, width: int) -> DataFrame:
    """One row: whether each (subspace, code) is there once with a finite centroid of the right width."""
    ok = (F.size("centroid") == width) & (F.size(F.filter("centroid", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))) == 0)
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subspace", "code").alias("u"), F.count_if(ok).alias("good"))
    return s.select("n", F.col("good").alias("n_good"), ((F.col("n") == m * k) & (F.col("u") == m * k) & (F.col("good") == m * k)).alias("valid"))


def from_rows(rows: DataFrame, p: Params, id: str = "id", vec: str = "vec") -> np.ndarray:
    """A codebook of the subvectors of the K rows of the smallest ids."""
    got = rows.orderBy(id).limit(p.k).select(V.doubles(vec).alias("v")).collect()
    if len(got) < p.k:
        raise ValueError("there are fewer rows than codes")
    return np.array([r["v"] for r in got]).reshape(p.k, p.m, p.width).transpose(1, 0, 2)


def lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> tuple[np.ndarray, float, bool]:
    """k-means++ and Lloyd on a matrix."""
    rng = np.random.default_rng(seed)
    c = [x[rng.integers(len(x))]]
    d = ((x - c[0]) ** 2).sum(1)
    while len(c) < k:
        c.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[len(c) % len(x)])
        d = np.minimum(d, ((x - c[-1]) ** 2).sum(1))
    c, last = np.array(c), np.inf
    for _ in range(rounds):
        own, now = np.zeros(len(x), np.int64), 0.0
        step = max(1, ELEMENTS // k)  # of all distances, so many at a time
        for i in range(0, len(x), step):
            part = x[i : i + step]
            dist = (part * part).sum(1)[:, None] - 2 * part @ c.T + (c * c).sum(1)[None]
            own[i : i + step] = dist.argmin(1)
            now += float(np.maximum(dist.min(1), 0).sum())
        size = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        if abs(last - now) < 1e-4:
            return c, now, True
        last = now
    return c, last, False


def train(rows: DataFrame, p: Params, sample: int = 65_536, id: str = "id", vec: str = "vec") -> tuple[np.ndarray, DataFrame]:
    """(codebook, stats by subspace), from at most ``sample`` rows by hash of id; a task a subspace."""
    spark = rows.sparkSession
    some = rows.select(F.xxhash64(F.col(id), F.lit(p.seed)).alias("_h"), F.col(id).alias("_id"), V.subvectors(vec, p.m, p.width).alias("s")).orderBy("_h", "_id").limit(sample)
    parts = some.select("_h", "_id", F.posexplode("s").alias("subspace", "x"))

    def fit(key, t):
        t = t.sort_by([("_h", "ascending"), ("_id", "ascending")])
        m = key[0].as_py()
        c, inertia, done = lloyd(matrix(t.column("x").combine_chunks()), p.k, p.rounds, p.seed + m)
        return pa.table({"subspace": pa.array([m], pa.int32()), "centroids": pa.array([c.ravel().tolist()], pa.list_(pa.float64())), "inertia": [inertia], "converged": [done]})

    got = parts.groupBy("subspace").applyInArrow(fit, "subspace int, centroids array<double>, inertia double, converged boolean").collect()  # m rows
    book = np.stack([np.array(r["centroids"]).reshape(p.k, p.width) for r in sorted(got, key=lambda r: r["subspace"])])
    return book, spark.createDataFrame([(r["subspace"], r["inertia"], r["converged"]) for r in got], "subspace int, inertia double, converged boolean")


def encode(rows: DataFrame, codebook: np.ndarray, vec: str = "vec", codes: str = "codes") -> DataFrame:
    """rows with the nearest centroid of each subspace (the first of equals)."""
    book = rows.sparkSession.sparkContext.broadcast(codebook)  # m x k centroids
    names = rows.columns
    at = names.index(vec)
    schema = T.StructType([*rows.schema.fields, T.StructField(codes, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = book.value
        m, k, w = c.shape
        for b in batches:
            x = matrix(b.column(at), m * w).reshape(-1, m, w)
            out = np.empty((len(x), m), np.int32)
            for i in range(m):
                out[:, i] = nearest(np.ascontiguousarray(x[:, i]), c[i])[0]
            codes_ = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * m + 1, m), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, codes_], [*names, codes])

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, codebook: DataFrame, codes: str = "codes", out: str = "decoded") -> DataFrame:
    """rows with the concatenated centroids of their codes; codebook: subspace, code, centroid."""
    book = codebook.groupBy("subspace").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "centroid"))), lambda s: s["centroid"]).alias("c"))
    book = book.agg(F.transform(F.array_sort(F.collect_list(F.struct("subspace", "c"))), lambda s: s["c"]).alias("_book"))
    return rows.crossJoin(F.broadcast(book)).withColumn(out, F.flatten(F.zip_with(codes, "_book", lambda code, c: F.get(c, code)))).drop("_book")


def reconstruction_error(rows: DataFrame, codebook: DataFrame, vec: str = "vec", codes: str = "codes") -> DataFrame:
    """One row: the mean norm of the error."""
    return decode(rows, codebook, codes).agg(F.avg(V.l2(vec, "decoded")).alias("mean_error"), F.count(F.lit(1)).alias("n"))


def sdc_table(codebook: DataFrame, metric: str = "l2") -> DataFrame:
    """subspace, c1, c2, d: between centroids of a subspace; squared for l2, so that sums are squared distances."""
    a = codebook.select("subspace", F.col("code").alias("c1"), F.col("centroid").alias("x"))
    b = codebook.select(F.col("subspace").alias("s2"), F.col("code").alias("c2"), F.col("centroid").alias("y"))
    term = V.l2_squared("x", "y") if metric == "l2" else V.distance(metric, "x", "y")
    return a.join(F.broadcast(b), F.col("subspace") == F.col("s2")).select("subspace", "c1", "c2", term.alias("d"))


def sdc(pairs: DataFrame, table_: DataFrame, metric: str = "l2", a: str = "a", b: str = "b", keys: tuple[str, ...] = ()) -> DataFrame:
    """Distances between code arrays a and b of each row (identified by keys) by table lookups."""
    cells = pairs.select(*keys, F.posexplode(F.arrays_zip(F.col(a).alias("c1"), F.col(b).alias("c2"))).alias("subspace", "z")).select(*keys, "subspace", "z.c1", "z.c2")
    # M x K x K rows: broadcast where they are few, else dealt by key
    terms = F.broadcast(table_) if table_.count() <= MAX_TERMS else table_
    total = cells.join(terms, ["subspace", "c1", "c2"]).groupBy(*keys).agg(F.sum("d").alias("_d"))
    return total.select(*keys, (F.sqrt("_d") if metric == "l2" else F.col("_d")).alias("distance"))


def adc_topk(queries: DataFrame, coded: DataFrame, codebook: np.ndarray, k: int, query_id: str = "query_id", id: str = "id", vec: str = "vec", codes: str = "codes") -> DataFrame:
    """The k nearest codes of each query by asymmetric (l2) distance: a lookup table a query, sums a row."""
    from .knn import FOUND, _rows, best

    spark = coded.sparkSession
    m, kk, w = codebook.shape
    rows = coded.select(F.col(id).cast("bigint").alias("id"), F.col(codes).alias("codes"))
    out = None
    for q_ids, q in query_blocks(queries, query_id, vec):
        for lo in range(0, len(q_ids), 256):  # tables of at most 256 queries at a time
            ids_, qq = q_ids[lo : lo + 256], q[lo : lo + 256].reshape(-1, m, 1, w)
            lut = spark.sparkContext.broadcast((ids_, ((qq - codebook[None]) ** 2).sum(-1)))

            def run(batches: Iterator[pa.RecordBatch], lut=lut) -> Iterator[pa.RecordBatch]:
                q_ids, t = lut.value
                held = tuple(np.zeros(0, x) for x in (np.int64, np.int64, float))
                for b in batches:
                    ids, c = np.asarray(b.column(0)), matrix(b.column(1), m).astype(np.int64)
                    d = np.zeros((len(q_ids), len(ids)))
                    for i in range(m):
                        d += t[:, i, c[:, i]]
                    d = np.sqrt(d)
                    n = len(ids)
                    if n > k:
                        limit = np.partition(d, k - 1, axis=1)[:, k - 1]
                        qi, xi = np.nonzero(d <= limit[:, None])
                    else:
                        qi, xi = np.nonzero(np.isfinite(d))
                    held = best(*(np.concatenate(z) for z in zip(held, (q_ids[qi], ids[xi], d[qi, xi]))), k)
                yield _rows(*held)

            part = rows.mapInArrow(run, FOUND)
            out = part if out is None else out.unionAll(part)
    return ranked(out if out is not None else spark.createDataFrame([], FOUND), k)


def search(queries: DataFrame, coded: DataFrame, codebook: np.ndarray, k: int, factor: int = 4, metric: str = "l2", query_id: str = "query_id", id: str = "id", vec: str = "vec") -> DataFrame:
    """Candidates on codes (factor * k), exact distances of those, sorted again."""
    cand = adc_topk(queries, coded, codebook, factor * k, query_id, id, vec)
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vec).alias("_q"))
    x = coded.select(F.col(id).alias("id"), F.col(vec).alias("_x"))
    exact = cand.drop("rank", "distance").join(x, "id").join(q, "query_id").select("query_id", "id", V.distance(metric, "_q", "_x").alias("distance"))
    return ranked(exact, k)
