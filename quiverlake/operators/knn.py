"""Exact nearest-neighbour joins, range joins, filtered search and their evaluation.

A search takes its queries to the base table in blocks of bounded size: each task
keeps the k best of each query over its rows, so that only tasks x queries x k rows
are shuffled, and a window takes the best of those. More queries mean more passes,
never a larger broadcast. Results are (query_id, id, rank, distance), equal
distances in the order of ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V

#: A block of queries has at most so many elements (32 MB of doubles).
BLOCK_ELEMENTS = 4 << 20
#: Distances that a task holds at a time, and elements of the pairs that it measures exactly (8 MB of doubles).
TILE = 1 << 20


def matrix(column: pa.Array, dimension: int | None = None) -> np.ndarray:
    """A list column as a double matrix; rows must have one dimension."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, int)
    d = dimension if dimension is not None else int(size[0]) if len(size) else 0
    if (size != d).any():
        raise ValueError(f"a vector's dimension is not {d}")
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, d)


def plain_distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(queries, rows) by matrix product, squared for l2; for l2, rows should lie about the origin."""
    products = q @ x.T
    if metric == "inner_product":
        return -products
    if metric == "cosine":
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
        return np.where(n == 0, 1.0, 1 - np.clip(products / np.where(n == 0, 1, n), -1, 1))
    if metric == "l2":
        return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * products, 0)
    raise ValueError(f"metric is one of {', '.join(V.METRICS)}")


def distances(metric: str | Callable, q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries, rows) of distances by matrix product (l2: squared), and how far rounding may have taken each from the true one."""
    if callable(metric):  # of pairs of rows; taken as right
        d = np.zeros((len(q), len(x)))
        for row, v in zip(d, q):  # copied at once: what the function returns may be a view of something as large as x
            row[:] = metric(np.broadcast_to(v, x.shape), x)
        return d, np.zeros_like(d)
    eps = 8 * max(1, q.shape[1]) * np.finfo(float).eps
    if metric != "l2":
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
        return plain_distances(metric, q, x), eps * n if metric == "inner_product" else np.full(n.shape, 2 * eps)
    # about the rows' mean: far from the origin the products would be much larger than the distances
    centre = x.mean(axis=0) if len(x) else 0.0
    a, b = q - centre, x - centre
    aa, bb = (a * a).sum(1)[:, None], (b * b).sum(1)[None]
    # the subtraction itself is off by an ulp of the coordinates
    moved = np.finfo(float).eps * (np.abs(q).max(1, initial=0)[:, None] + np.abs(x).max(1, initial=0)[None])
    return plain_distances(metric, a, b), eps * (aa + bb) + 4 * np.sqrt(q.shape[1]) * moved * (np.sqrt(aa) + np.sqrt(bb) + moved)


def exact(metric: str | Callable, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, element by element, as the column builders add."""
    if callable(metric):
        return np.asarray(metric(q, x), float)
    if metric == "l2":
        d = q - x
        return np.sqrt(np.cumsum(d * d, axis=1)[:, -1])
    dot = np.cumsum(q * x, axis=1)[:, -1]
    if metric == "inner_product":
        return -dot
    n = np.sqrt(np.cumsum(q * q, axis=1)[:, -1]) * np.sqrt(np.cumsum(x * x, axis=1)[:, -1])
    return np.where(n == 0, 1.0, 1 - np.clip(dot / np.where(n == 0, 1, n), -1, 1))


def query_blocks(queries: DataFrame, query_id: str, vec: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows, size = [], [], 0
    for r in queries.select(F.col(query_id).cast("bigint"), V.doubles(vec)).orderBy(query_id).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        size += len(r[1])
        if size >= BLOCK_ELEMENTS:
            yield np.array(ids), np.array(rows, float)
            ids, rows, size = [], [], 0
    if ids:
        yield np.array(ids), np.array(rows, float)


FOUND = "query_id bigint, id bigint, distance double"
EMPTY = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])


def _rows(q: np.ndarray, i: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(d)], schema=EMPTY)


def best(q: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k first of each query by (distance, id)."""
    order = np.lexsort((ids, d, q))
    q, ids, d = q[order], ids[order], d[order]
    start = np.searchsorted(q, q)
    keep = np.arange(len(q)) - start < k
    return q[keep], ids[keep], d[keep]


def ranked(found: DataFrame, k: int | None) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    out = found.withColumn("rank", F.row_number().over(w))
    return (out.where(F.col("rank") <= k) if k else out).select("query_id", "id", "rank", "distance")


def _measured(metric: str | Callable, q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """exact of the pairs of rows (qi, xi), a bounded number at a time."""
    step = max(1, TILE // max(1, q.shape[1]))
    return np.concatenate([np.zeros(0), *(exact(metric, q[qi[i : i + step]], x[xi[i : i + step]]) for i in range(0, len(qi), step))])


def scanned(batches: Iterator[pa.RecordBatch], q_ids: np.ndarray, q: np.ndarray, metric: str | Callable, take: Callable, k: int | None, self_join: bool) -> Iterator[pa.RecordBatch]:
    """What a task finds in its rows (id, vec) for a block of queries, a tile of ``TILE`` distances at a time."""
    held = {}
    for b in batches:
        for i in range(0, b.num_rows, 4096):
            part = b.slice(i, 4096)
            x, ids = matrix(part.column(1), q.shape[1]), np.asarray(part.column(0))
            step = max(1, TILE // 4096)
            for j in range(0, len(q), step):
                own, own_ids = q[j : j + step], q_ids[j : j + step]
                d, off = distances(metric, own, x)
                if self_join:
                    d[own_ids[:, None] == ids[None]] = np.inf
                qi, xi = take(d - off, d + off)
                if self_join:
                    other = own_ids[qi] != ids[xi]
                    qi, xi = qi[other], xi[other]
                got = own_ids[qi], ids[xi], _measured(metric, own, x, qi, xi)
                if k is None:
                    yield _rows(*got)
                else:
                    held[j] = best(*(np.concatenate(c) for c in zip(held[j], got)), k) if j in held else best(*got, k)
    for j in sorted(held):
        yield _rows(*held[j])


def nearest(k: int) -> Callable:
    def take(least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if least.shape[1] <= k:
            return np.nonzero(np.isfinite(least))
        limit = np.partition(most, k - 1, axis=1)[:, k - 1]
        # all that rounding may have put beyond the k-th are kept for the exact distance
        return np.nonzero((least <= limit[:, None]) & np.isfinite(least))

    return take


def _scan(queries: DataFrame, base: DataFrame, metric: str, take: Callable, k: int | None, query_id: str, id: str, vec: str, self_join: bool) -> DataFrame:
    spark = base.sparkSession
    rows = base.select(F.col(id).cast("bigint").alias("id"), F.col(vec).alias("vec"))
    out = None
    for q_ids, q in query_blocks(queries, query_id, vec):
        block = spark.sparkContext.broadcast((q_ids, q))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            return scanned(batches, *block.value, metric, take, k, self_join)

        part = rows.mapInArrow(run, FOUND)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], FOUND)


def topk_join(queries: DataFrame, base: DataFrame, k: int, metric: str | Callable = "l2", query_id: str = "query_id", id: str = "id", vec: str = "vec", self_join: bool = False) -> DataFrame:
    """The k nearest rows of base for each query (all, if there are fewer). metric: a name, or a function of two matrices that gives the distance of each pair of their rows."""
    if k < 1:
        raise ValueError("k is at least 1")
    return ranked(_scan(queries, base, metric, nearest(k), k, query_id, id, vec, self_join), k)


def knn(base: DataFrame, query: list[float], k: int, metric: str = "l2", id: str = "id", vec: str = "vec") -> DataFrame:
    """The k nearest rows of one query: a projection and a bounded sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = V.same_dimension(vec, len(query))
    rows = base.select(F.col(id).cast("bigint").alias("id"), V.distance(metric, q, v).alias("distance"))
    top = rows.orderBy("distance", "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))


def range_join(queries: DataFrame, base: DataFrame, radius: float, metric: str = "l2", max_results: int = 0, query_id: str = "query_id", id: str = "id", vec: str = "vec") -> DataFrame:
    """All rows within the radius (inclusive) of each query, or the nearest max_results of them (0: no limit); metric as in topk_join."""

    def take(least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = radius * abs(radius) if metric == "l2" else radius
        return np.nonzero(least <= r + 1e-15 * abs(r))

    found = _scan(queries, base, metric, take, None, query_id, id, vec, False).where(F.col("distance") <= radius)
    return ranked(found, max_results or None)


def range_by_topk(queries: DataFrame, base: DataFrame, radius: float, search_size: int, metric: str = "l2", **names) -> DataFrame:
    """The k nearest, k = search_size, cut at the radius."""
    return topk_join(queries, base, search_size, metric, **names).where(F.col("distance") <= radius)


def filtered_topk(queries: DataFrame, base: DataFrame, k: int, predicate: Column, metric: str = "l2", id: str = "id", labels: str | None = None, **names) -> DataFrame:
    """Top k of the rows that pass the predicate; with ``labels``, that column too."""
    rows = base.where(predicate)
    out = topk_join(queries, rows, k, metric, id=id, **names)
    if labels is None:
        return out
    return out.join(rows.select(F.col(id).alias("id"), F.col(labels)), "id").select("query_id", "id", "rank", "distance", labels)


def entry_point(base: DataFrame, query: list[float], predicate: Column, entry: int, metric: str = "l2", id: str = "id", vec: str = "vec") -> DataFrame:
    """The graph's entry if it passes the predicate, else the nearest row that does."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = base.where(predicate).select(F.col(id).alias("id"), V.distance(metric, q, F.col(vec)).alias("d"))
    return rows.agg(F.min_by("id", F.struct(F.col("id") != entry, "d", "id")).alias("id"))


def without(base: DataFrame, deleted: DataFrame, id: str = "id") -> DataFrame:
    """base without the deleted ids."""
    return base.join(deleted.select(F.col(id).alias("_gone")).distinct(), F.col(id) == F.col("_gone"), "left_anti")


def distance_to(base: DataFrame, query: list[float], ids: list[int], metric: str = "l2", id: str = "id", vec: str = "vec") -> DataFrame:
    """id, distance of the named rows to one query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return base.where(F.col(id).isin(ids)).select(F.col(id).cast("bigint").alias("id"), V.distance(metric, q, V.same_dimension(vec, len(query))).alias("distance"))


SUMMARY = "query_id bigint, n bigint, total double, nearest double, farthest double"


def distance_summary(queries: DataFrame, base: DataFrame, metric: str = "l2", query_id: str = "query_id", id: str = "id", vec: str = "vec") -> DataFrame:
    """Every query against every row, as query_id, n, total, nearest and farthest: summed in the tasks, so no pair leaves them."""
    spark = base.sparkSession
    rows, out = base.select(F.col(vec).alias("vec")), None
    for q_ids, q in query_blocks(queries, query_id, vec):
        block = spark.sparkContext.broadcast((q_ids, q))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            q_ids, q = block.value
            n, total, low, high = 0, np.zeros(len(q)), np.full(len(q), np.inf), np.full(len(q), -np.inf)
            step = max(1, BLOCK_ELEMENTS // max(1, len(q) * q.shape[1]))
            for b in batches:
                for i in range(0, b.num_rows, step):
                    x = matrix(b.slice(i, step).column(0), q.shape[1])
                    d = exact(metric, np.repeat(q, len(x), 0), np.tile(x, (len(q), 1))).reshape(len(q), -1)
                    n, total, low, high = n + len(x), total + d.sum(1), np.minimum(low, d.min(1, initial=np.inf)), np.maximum(high, d.max(1, initial=-np.inf))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(np.full(len(q), n)), *map(pa.array, (total, low, high))], ["query_id", "n", "total", "nearest", "farthest"])

        part = rows.mapInArrow(run, SUMMARY)
        out = part if out is None else out.unionAll(part)
    if out is None:
        return spark.createDataFrame([], SUMMARY)
    return out.groupBy("query_id").agg(*[f(c).alias(c) for f, c in ((F.sum, "n"), (F.sum, "total"), (F.min, "nearest"), (F.max, "farthest"))])


def overfetch(queries: DataFrame, base: DataFrame, deleted: DataFrame, k: int, metric: str = "l2", id: str = "id", **names) -> DataFrame:
    """The k nearest rows that aren't deleted, at most k from each task: the deleted ones leave before the search, so however many they are, no room is fetched for them."""
    live = without(base, deleted, id)
    return topk_join(queries, live, k, metric, id=id, **names)


# ---------------------------------------------------------------- evaluation


def recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: mean recall at k over truth's queries, strict recall at 1, and how often the top result is among the k true ones."""
    t = truth.where(F.col("rank") <= k).select("query_id", F.col("id").alias("t_id"), F.col("rank").alias("t_rank"))
    r = results.where(F.col("rank") <= k).select(F.col("query_id").alias("_q"), F.col("id").alias("r_id"), F.col("rank").alias("r_rank"))
    hit = t.join(r, (t["query_id"] == r["_q"]) & (t["t_id"] == r["r_id"]), "left")
    by = hit.groupBy("query_id").agg((F.count("r_id") / k).alias("recall"), F.max(F.when((F.col("t_rank") == 1) & (F.col("r_rank") == 1), 1.0).otherwise(0.0)).alias("first"), F.max(F.when(F.col("r_rank") == 1, 1.0).otherwise(0.0)).alias("top_in"))
    return by.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("recall").alias("recall_at_k"), F.avg("first").alias("recall_at_1"), F.avg("top_in").alias("top1_in_truth_k"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: ranks at which two results have different ids, and the largest difference of distances."""
    x = a.select("query_id", "rank", F.col("id").alias("ia"), F.col("distance").alias("da"))
    y = b.select("query_id", "rank", F.col("id").alias("ib"), F.col("distance").alias("db"))
    both = x.join(y, ["query_id", "rank"], "full")
    return both.agg(F.count(F.lit(1)).alias("n_ranks"), F.count_if(~F.col("ia").eqNullSafe(F.col("ib"))).alias("n_different"), F.max(F.abs(F.col("da") - F.col("db"))).alias("max_distance_difference"))
