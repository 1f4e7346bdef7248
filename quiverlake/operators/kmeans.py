"""Lloyd's k-means as DataFrame steps, and the assignment join it shares with product quantization.

Centroids are few (k rows of a bounded size) and are broadcast as an array; points
never leave their tasks but as partial sums, a row a task and cluster.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from .knn import distances, exact, matrix

#: Distances that a task holds at a time.
ELEMENTS = 4 << 20


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (the first of equals) and its squared distance."""
    code, d2 = np.zeros(len(x), np.int64), np.zeros(len(x))
    step = max(1, ELEMENTS // max(1, len(c)))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        d, off = distances("l2", part, c)
        least = (d + off).min(axis=1)
        row, k = np.nonzero(d - off <= least[:, None])  # all that rounding leaves open
        true = exact("l2", part[row], c[k]) ** 2
        order = np.lexsort((k, true, row))
        first = order[np.searchsorted(row[order], np.arange(len(part)))]
        code[i : i + step], d2[i : i + step] = k[first], true[first]
    return code, d2


def assign(points: DataFrame, centroids: list[list[float]], vec: str = "vec") -> DataFrame:
    """points with code (nearest centroid; the first of equals) and d2."""
    book = points.sparkSession.sparkContext.broadcast(np.array(centroids, float))
    rows = points.withColumn("_v", V.doubles(vec))
    names = points.columns
    schema = T.StructType([*points.schema.fields, T.StructField("code", T.IntegerType()), T.StructField("d2", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = book.value
        for b in batches:
            code, d2 = nearest(matrix(b.column(len(names)), c.shape[1]), c)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(code.astype(np.int32)), pa.array(d2)], [*names, "code", "d2"])

    return rows.mapInArrow(run, schema)


def inertia(points: DataFrame, centroids: list[list[float]], vec: str = "vec") -> DataFrame:
    return assign(points, centroids, vec).agg(F.sum("d2").alias("inertia"), F.count(F.lit(1)).alias("n"))


def sums(points: DataFrame, centroids: list[list[float]], vec: str = "vec") -> DataFrame:
    """code, n, total (array) and d2 of each cluster that has points: a task's points are summed before they leave it."""
    book = points.sparkSession.sparkContext.broadcast(np.array(centroids, float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = book.value
        n, total, cost = np.zeros(len(c), np.int64), np.zeros_like(c), np.zeros(len(c))
        for b in batches:
            x = matrix(b.column(0), c.shape[1])
            code, d2 = nearest(x, c)
            n += np.bincount(code, minlength=len(c))
            cost += np.bincount(code, d2, len(c))
            np.add.at(total, code, x)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(total[own].tolist(), pa.list_(pa.float64())), pa.array(cost[own])], ["code", "n", "total", "d2"])

    parts = points.select(V.doubles(vec).alias("v")).mapInArrow(run, "code int, n bigint, total array<double>, d2 double")
    by_place = parts.select("code", "n", "d2", F.posexplode("total").alias("p", "x")).groupBy("code", "p").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("d2").alias("d2"))
    return by_place.groupBy("code").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("total"), F.max("d2").alias("d2"))


def means(points: DataFrame, centroids: list[list[float]], vec: str = "vec") -> DataFrame:
    """code, mean of each cluster that has points."""
    return sums(points, centroids, vec).select("code", F.transform("total", lambda x: x / F.col("n")).alias("mean"))


def update(points: DataFrame, centroids: list[list[float]], vec: str = "vec") -> tuple[list[list[float]], float]:
    """Mean of each cluster (an empty one keeps its centroid), and the inertia before."""
    new, total = [list(c) for c in centroids], 0.0
    for r in sums(points, centroids, vec).orderBy("code").collect():  # k rows
        new[r["code"]] = [x / r["n"] for x in r["total"]]
        total += r["d2"]
    return new, total


def first_centroids(points: DataFrame, k: int, id: str = "id", vec: str = "vec", seed: int = 42, method: str = "random") -> list[list[float]]:
    """k rows by hash order, or by k-means++ on a sample of at most 20 k + 1000 rows."""
    some = points.select(F.xxhash64(F.col(id), F.lit(seed)).alias("h"), V.doubles(vec).alias("v")).orderBy("h").limit(k if method == "random" else 20 * k + 1000).collect()
    if len(some) < k:
        raise ValueError("there are fewer points than clusters")
    x = np.array([r["v"] for r in some])
    if method == "random":
        return x.tolist()
    rng = np.random.default_rng(seed)
    out = [x[rng.integers(len(x))]]
    d = ((x - out[0]) ** 2).sum(1)
    while len(out) < k:
        out.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[len(out)])
        d = np.minimum(d, ((x - out[-1]) ** 2).sum(1))
    return [c.tolist() for c in out]


def fit(points: DataFrame, k: int, rounds: int | None = None, tolerance: float = 1e-4, id: str = "id", vec: str = "vec", seed: int = 42, method: str = "kmeans++") -> tuple[list[list[float]], float, bool]:
    """(centroids, inertia, converged). Without ``rounds`` it goes on until it has converged: larger tables take more rounds, but the inertia only falls, and clusterings are finite in number. Where it doesn't fall any more but by rounding, that is the end too."""
    c, last = first_centroids(points, k, id, vec, seed, method), float("inf")
    for _ in itertools.count() if rounds is None else range(rounds):
        c, now = update(points, c, vec)
        if last - now < tolerance:
            return c, now, True
        last = now
    return c, last, False


def elbow(points: DataFrame, ks: range, trials: int = 3, rounds: int = 20, **names) -> DataFrame:
    """k, inertia: the least of several trials."""
    rows = [(k, min(fit(points, k, rounds, seed=42 + t, **names)[1] for t in range(trials))) for k in ks]
    return points.sparkSession.createDataFrame(rows, "k int, inertia double")


def medoid(rows: DataFrame, id: str = "id", vec: str = "vec") -> DataFrame:
    """One row: of every n / floor(sqrt n)-th row (ids from 0), the one with the least total distance to the others."""
    n = rows.count()
    step = max(1, n // max(1, int(n**0.5)))
    some = rows.where(F.col(id) % step == 0).select(F.col(id).alias("id"), V.doubles(vec).alias("v"))
    other = some.select(F.col("v").alias("w"))
    total = some.crossJoin(F.broadcast(other)).groupBy("id").agg(F.sum(V.l2("v", "w")).alias("total"))  # about sqrt n rows each
    return total.agg(F.min_by("id", F.struct("total", "id")).alias("id"), F.min("total").alias("total"))
