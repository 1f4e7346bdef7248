"""Proximity-graph index: built per shard, searched in all shards, merged by the same top-k window as exact search.

A shard is a bounded number of rows (``shard_rows``); more rows mean more shards. A
graph is a table of nodes (a row a vertex), or, as it is stored and searched, of packed
shards (a row a shard: vectors, lists, labels and codes as arrays), which a search reads
without a shuffle. Pruning follows the published rule for pruned proximity graphs: a
candidate goes if a kept neighbour, alpha times as far from it as the vertex, is nearer;
where that leaves less than half of the degree, the nearest that went come back. The
search keeps the best ``beam`` vertices and ends when all of them are expanded. A shard
is built from its vertices' nearest others, found by matrix products, for all vertices at
once; later rows are inserted one by one, from what a search for them comes upon.
``build_whole`` makes one graph of all rows instead, merged from overlapping parts.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.shared import scratch_path, stage
from .knn import FOUND, TILE, exact, matrix, plain_distances, query_blocks, ranked


@dataclass(frozen=True)
class IndexParams:
    metric: str = "l2"
    degree: int = 64
    beam: int = 100
    alpha: float = 1.2

    def __post_init__(self) -> None:
        if self.metric not in V.METRICS or self.degree < 1 or self.beam < 1 or self.alpha < 1:
            raise ValueError("metric by name, degree and beam of 1 or more, alpha of 1 or more")


def positive(metric: str, d: np.ndarray) -> np.ndarray:
    """Distances that alpha can multiply: inner products are shifted to start at zero."""
    return d - d.min() if metric == "inner_product" and len(d) else d


def robust_prune(ids: np.ndarray, d: np.ndarray, between: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Places of the kept candidates. d: to the vertex; between: among candidates."""
    nearest = list(np.lexsort((ids, d)))
    left = list(nearest)
    kept: list[int] = []
    while left and len(kept) < degree:
        c = left.pop(0)
        kept.append(c)
        left = [x for x in left if alpha * between[c, x] > d[x]]
    if len(kept) < degree // 2:
        have = set(kept)
        kept += [x for x in nearest if x not in have][: degree // 2 - len(kept)]
    return np.array(kept, np.int64)


def occlude_factor(to_selected: np.ndarray, to_vertex: float) -> float:
    """Least distance to a selected neighbour over the distance to the vertex; under 1: occluded."""
    return float("inf") if not len(to_selected) or to_vertex == 0 else float(to_selected.min() / to_vertex)


class Graph:
    """Adjacency lists over a matrix (for l2 about its mean, where products are exact enough)."""

    def __init__(self, x: np.ndarray, params: IndexParams):
        self.centre = x.mean(axis=0) if params.metric == "l2" and len(x) else 0.0
        self.x, self.p, self.n = x - self.centre, params, len(x)
        self.neighbors: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(self.n)]
        self.entry = self.medoid() if self.n else 0
        self.live = np.ones(self.n, bool)

    def dist(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return plain_distances(self.p.metric, q[None], self.x[rows])[0]

    def medoid(self) -> int:
        step = max(1, self.n // max(1, int(self.n**0.5)))
        some = np.arange(0, self.n, step)
        return int(some[plain_distances(self.p.metric, self.x[some], self.x[some]).sum(1).argmin()])

    def search(self, q: np.ndarray, beam: int | None = None, allowed: np.ndarray | None = None, radius: float | None = None) -> tuple[list[tuple[float, int]], dict[str, int]]:
        """Best vertices by (distance, vertex), and counters. Vertices that aren't allowed are passed through, not returned. With a radius (of dist's distances), all vertices inside are expanded however many they are, and all that were met are returned."""
        beam = beam or self.p.beam
        reach = -np.inf if radius is None else radius
        start = float(self.dist(q, np.array([self.entry]))[0])
        seen = np.zeros(self.n, bool)
        seen[self.entry] = True
        todo, kept, found = [(start, self.entry)], [(-start, -self.entry)], []
        visited, computed = 0, 1
        if allowed is None or allowed[self.entry]:
            found.append((start, self.entry))
        while todo:
            d, v = heapq.heappop(todo)
            if len(kept) >= beam and d > -kept[0][0] and d > reach:
                break
            visited += 1
            new = self.neighbors[v]
            new = new[~seen[new]]
            if not len(new):
                continue
            seen[new] = True
            dn = self.dist(q, new)
            computed += len(new)
            for e, u in zip(dn.tolist(), new.tolist()):
                if len(kept) < beam or e < -kept[0][0] or e <= reach:
                    heapq.heappush(todo, (e, u))
                    heapq.heappush(kept, (-e, -u))
                    if len(kept) > beam:
                        heapq.heappop(kept)
                if self.live[u] and (allowed is None or allowed[u]):
                    found.append((e, u))
        return sorted(found)[: beam if radius is None else None], {"visited": visited, "computed": computed}

    def prune(self, v: int, cand: np.ndarray) -> np.ndarray:
        cand = np.unique(cand[cand != v])
        d = self.dist(self.x[v], cand)
        between = plain_distances(self.p.metric, self.x[cand], self.x[cand])
        if self.p.metric == "l2":
            d, between = np.sqrt(d), np.sqrt(between)
        elif self.p.metric == "inner_product":
            low = min(d.min(initial=0), between.min(initial=0))
            d, between = d - low, between - low
        return cand[robust_prune(cand, d, between, self.p.degree, self.p.alpha)]

    def insert(self, v: int) -> None:
        got, _ = self.search(self.x[v])
        cand = np.array([u for _, u in got if u != v], np.int64)
        if not len(cand):
            return
        self.neighbors[v] = self.prune(v, cand)
        for u in self.neighbors[v].tolist():
            if v not in self.neighbors[u]:
                grown = np.append(self.neighbors[u], v)
                self.neighbors[u] = grown if len(grown) <= self.p.degree else self.prune(u, grown)

    def grow(self, x: np.ndarray) -> np.ndarray:
        """New vertices at the end, not yet linked; their numbers."""
        at = np.arange(self.n, self.n + len(x))
        self.x = np.concatenate([self.x, x - self.centre]) if self.n else x - self.centre
        self.neighbors += [np.zeros(0, np.int64) for _ in at]
        self.live = np.append(self.live, np.ones(len(at), bool))
        self.n += len(at)
        return at

    def pointing_to(self, v: int) -> list[int]:
        """The vertices that have v in their lists."""
        ends = np.cumsum([len(n) for n in self.neighbors])
        return np.unique(np.searchsorted(ends, np.flatnonzero(np.concatenate(self.neighbors) == v), side="right")).tolist() if self.n else []

    def delete(self, v: int) -> None:
        """Takes v out of the results and the lists; its neighbours get each other."""
        self.live[v] = False
        own = self.neighbors[v]
        for u in self.pointing_to(v):
            cand = np.union1d(self.neighbors[u], own)
            cand = cand[(cand != v) & (cand != u) & self.live[cand]]
            self.neighbors[u] = self.prune(u, cand) if len(cand) else cand
        if self.entry == v:
            self.entry = self.valid_entry()
        self.neighbors[v] = np.zeros(0, np.int64)

    def valid_entry(self) -> int:
        """The entry if it is live, else a live neighbour of it, else the first live vertex."""
        if not self.live.any() or self.live[self.entry]:
            return self.entry
        own = self.neighbors[self.entry]
        own = own[self.live[own]]
        return int(own[0]) if len(own) else int(np.flatnonzero(self.live)[0])

    def prune_edges(self, v: int) -> None:
        """Cuts v's list to the degree; those that leave it drop v too."""
        had = self.neighbors[v]
        if len(had) > self.p.degree:
            self.neighbors[v] = self.prune(v, had)
            for u in np.setdiff1d(had, self.neighbors[v]).tolist():
                self.neighbors[u] = self.neighbors[u][self.neighbors[u] != v]

    # -------------------------------------------------------- all vertices at once

    def near(self, count: int, seed: int, tile: int = TILE) -> np.ndarray:
        """(n, count) candidates of each vertex: the nearest, by matrix products of a tile of distances at a time, and for a quarter of them any vertices, which make the long edges; -1 where there are fewer."""
        block = max(1, tile // max(1, self.n))
        far = min(count // 4, max(0, self.n - 1))
        close = min(count - far, self.n - 1)
        out = np.full((self.n, count), -1, np.int64)
        rng = np.random.default_rng(seed)
        for i in range(0, self.n, block):
            own = np.arange(i, min(self.n, i + block))
            d = plain_distances(self.p.metric, self.x[own], self.x)
            d[np.arange(len(own)), own] = np.inf
            out[own, :close] = np.argpartition(d, close - 1, axis=1)[:, :close]
            out[own, close : close + far] = rng.integers(0, self.n, (len(own), far))
        return out

    def prune_all(self, cand: np.ndarray, block: int = 256) -> list[np.ndarray]:
        """robust_prune of every vertex's candidates (n, c), a block of vertices at a time."""
        out: list[np.ndarray] = []
        degree, alpha = self.p.degree, self.p.alpha
        for i in range(0, self.n, block):
            own = np.arange(i, min(self.n, i + block))
            c = np.sort(cand[own], axis=1)
            ok = (c >= 0) & (c != own[:, None])
            ok[:, 1:] &= c[:, 1:] != c[:, :-1]
            x = self.x[c]  # (vertices, candidates, dimension)
            if self.p.metric == "cosine":
                norm = np.linalg.norm(x, axis=2)
                x = x / np.where(norm == 0, 1, norm)[:, :, None]
                q = self.x[own] / np.maximum(np.linalg.norm(self.x[own], axis=1), 1e-300)[:, None]
                d, between = 1 - np.einsum("bcd,bd->bc", x, q), 1 - x @ x.transpose(0, 2, 1)
            else:
                dot, both = np.einsum("bcd,bd->bc", x, self.x[own]), x @ x.transpose(0, 2, 1)
                size = np.einsum("bcc->bc", both)
                d, between = size - 2 * dot + (self.x[own] ** 2).sum(1)[:, None], size[:, :, None] + size[:, None] - 2 * both
                d, between = np.sqrt(np.maximum(d, 0)), np.sqrt(np.maximum(between, 0))
            d = np.where(ok, d, np.inf)
            order = np.lexsort((c, d), axis=1)
            c, d, left = (np.take_along_axis(z, order, 1) for z in (c, d, ok))
            between = np.take_along_axis(np.take_along_axis(between, order[:, :, None], 1), order[:, None], 2)
            kept, row = np.zeros_like(left), np.arange(len(own))
            for _ in range(min(degree, c.shape[1])):
                some = left.any(axis=1)
                if not some.any():
                    break
                k = left.argmax(axis=1)  # the nearest that is left
                kept[row[some], k[some]] = True
                left &= alpha * between[row, k] > d
                left[row, k] = False
            short = np.flatnonzero(kept.sum(axis=1) < degree // 2)
            for r in short.tolist():
                more = np.flatnonzero(~kept[r] & np.isfinite(d[r]))[: degree // 2 - int(kept[r].sum())]
                kept[r, more] = True
            out += [c[r, kept[r]] for r in range(len(own))]
        return out

    def unreached(self) -> np.ndarray:
        """Vertices that no path from the entry reaches."""
        seen = np.zeros(self.n, bool)
        front = np.array([self.entry])
        while len(front):
            seen[front] = True
            new = np.unique(np.concatenate([self.neighbors[v] for v in front.tolist()]))
            front = new[~seen[new]]
        return np.flatnonzero(~seen)

    def build(self, seed: int = 42) -> Graph:
        """Lists of all vertices at once: pruned candidates, then those with the vertices that point at each, pruned again; last, vertices that nothing leads to are linked from their nearest that can be reached."""
        if self.n < 2:
            return self
        if self.p.metric == "inner_product":
            # with one more coordinate that makes all norms equal, the largest products are the least distances
            size = (self.x * self.x).sum(1)
            same = Graph(np.column_stack([self.x, np.sqrt(np.maximum(size.max() - size, 0))]), IndexParams("l2", self.p.degree, self.p.beam, self.p.alpha)).build(seed)
            self.neighbors, self.entry = same.neighbors, same.entry
            return self
        width = max(self.p.beam, self.p.degree) + self.p.degree // 2
        out = self.prune_all(self.near(min(width, 2 * self.n), seed))
        at = np.repeat(np.arange(self.n), [len(n) for n in out])
        to = np.concatenate(out)
        # each vertex's own list and those that point at it, the nearest first, as many as candidates before
        a, b = np.concatenate([at, to]), np.concatenate([to, at])
        d = np.empty(len(a))
        for i in range(0, len(a), 1 << 18):
            x, y = self.x[a[i : i + (1 << 18)]], self.x[b[i : i + (1 << 18)]]
            d[i : i + (1 << 18)] = ((x - y) ** 2).sum(1) if self.p.metric == "l2" else -(x * y).sum(1)
        order = np.lexsort((d, a))
        a, b = a[order], b[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        keep = place < width
        cand = np.full((self.n, width), -1, np.int64)
        cand[a[keep], place[keep]] = b[keep]
        self.neighbors = self.prune_all(cand)
        for _ in range(8):
            lost = self.unreached()
            if not len(lost):
                break
            known = np.setdiff1d(np.arange(self.n), lost)
            for i in range(0, len(lost), 1024):
                own = lost[i : i + 1024]
                step = max(1, TILE // len(known))
                nearest = known[np.concatenate([plain_distances("l2", self.x[own[j : j + step]], self.x[known]).argmin(axis=1) for j in range(0, len(own), step)])]
                order = np.argsort(nearest, kind="stable")
                before = -1
                for u, v in zip(nearest[order].tolist(), own[order].tolist()):
                    self._lead(u if u != before else last, v)  # several of one vertex in a row
                    before, last = u, v
        return self

    def _lead(self, u: int, v: int) -> None:
        """An edge from u to v, in the place of u's furthest where there is no room."""
        own = self.neighbors[u]
        if len(own) >= self.p.degree:
            own = np.delete(own, self.dist(self.x[u], own).argmax())
        self.neighbors[u] = np.append(own[own != v], v)


NODES = "shard bigint, id bigint, entry boolean, vec array<double>, neighbors array<bigint>"


def build(rows: DataFrame, params: IndexParams = IndexParams(), shard_rows: int = 20_000, id: str = "id", vec: str = "vec", seed: int = 42) -> DataFrame:
    """nodes: shard, id, entry, vec, neighbors (ids of the same shard)."""
    n = rows.count()
    shards = max(1, -(-n // shard_rows))

    def make(key, t):
        ids = np.asarray(t.column("id"))
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], matrix(t.column("vec").combine_chunks())[order]
        g = Graph(x, params).build(seed)
        return pa.table(
            {"shard": pa.array([key[0].as_py()] * len(ids), pa.int64()), "id": ids, "entry": np.arange(len(ids)) == g.entry, "vec": pa.array(x.tolist(), pa.list_(pa.float64())), "neighbors": pa.array([ids[v].tolist() for v in g.neighbors], pa.list_(pa.int64()))}
        )

    keyed = rows.select(F.pmod(F.xxhash64(F.col(id)), F.lit(shards)).alias("shard"), F.col(id).cast("bigint").alias("id"), V.doubles(vec).alias("vec"))
    return keyed.groupBy("shard").applyInArrow(make, NODES)


#: Rows that a whole graph's cells are made about, at most (8 MB of 64 doubles).
PIVOTS = 16_384


def build_whole(rows: DataFrame, params: IndexParams = IndexParams(), part_rows: int = 20_000, id: str = "id", vec: str = "vec", seed: int = 42) -> DataFrame:
    """nodes of one graph over all rows (shard 0), however many; a task holds at most about part_rows of them.

    Each row is in the cells of its two nearest pivots, which are some of the rows, and in one
    part of rows dealt by hash; cells of more than part_rows are dealt by hash too. The parts'
    graphs share degree and beam, and a vertex's list is all that it has in its parts: near ones
    from the cells, long edges from the hash. The parts' entries are a tree under the graph's,
    so that all that a part's entry reaches can be reached. Searches, changes and pruning of
    nodes go by shard and would take the whole graph into a task.
    """
    spark = rows.sparkSession
    n = rows.count()
    if n <= part_rows:
        return build(rows, params, part_rows, id, vec, seed)
    rows = rows.select(F.col(id).cast("bigint").alias("id"), V.doubles(vec).alias("vec"))
    far = max(1, params.degree // 4)
    close = max(1, (params.degree - far - 2) // 2)  # two cells, and two places for the tree
    share = lambda degree: replace(params, degree=degree, beam=max(1, params.beam * degree // params.degree))

    def place(x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True) if params.metric == "cosine" else np.ones((len(x), 1))
        return x / np.where(norm == 0, 1, norm)

    some = rows.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, -(-8 * n // part_rows))).toArrow()
    x = matrix(some.column("vec"))
    _, first = np.unique(place(x), axis=0, return_index=True)
    first.sort()
    top = some.column("id")[int(first[Graph(x[first], params).entry])].as_py()
    centre = place(x[first]).mean(axis=0)
    pivots = spark.sparkContext.broadcast(place(x[first]) - centre)
    mixed = len(first)  # the cell of all rows

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, TILE // mixed)
        for b in batches:
            for i in range(0, b.num_rows, step):
                own = b.slice(i, step)
                d = plain_distances("l2", place(matrix(own.column(1), len(centre))) - centre, pivots.value)
                cells = [d.argmin(axis=1)]
                if mixed > 1:
                    d[np.arange(len(d)), cells[0]] = np.inf
                    cells.append(d.argmin(axis=1))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(np.column_stack([*cells, np.full(len(d), mixed)]).tolist(), pa.list_(pa.int64()))], ["id", "vec", "cells"])

    placed = stage(rows.mapInArrow(deal, "id bigint, vec array<double>, cells array<bigint>"), "cells")
    plan, parts = [], 0
    for cell, size in sorted(placed.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()):
        pieces = -(-(4 * size if cell == mixed else size) // part_rows)
        plan.append((cell, parts, pieces))
        parts += pieces
    dealt = placed.select("id", "vec", F.explode("cells").alias("cell")).join(F.broadcast(spark.createDataFrame(plan, "cell bigint, first bigint, pieces bigint")), "cell")
    dealt = dealt.select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("pieces"))).alias("part"), (F.col("cell") == mixed).alias("mixed"), "id", "vec")

    def make(key, t):
        ids = np.asarray(t.column("id"))
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], matrix(t.column("vec").combine_chunks())[order]
        g = Graph(x, share(far if key[1].as_py() else close)).build(seed)
        return pa.table({"part": pa.array([key[0].as_py()] * len(ids), pa.int64()), "id": ids, "entry": np.arange(len(ids)) == g.entry, "neighbors": pa.array([ids[v].tolist() for v in g.neighbors], pa.list_(pa.int64()))})

    # a number of partitions of its own, as adaptive execution would join what is few bytes and much work
    lists = stage(dealt.repartition(min(parts, 2000), "part").groupBy("part", "mixed").applyInArrow(make, "part bigint, id bigint, entry boolean, neighbors array<bigint>"), "lists")
    entries = [top] + sorted(r[0] for r in lists.where("entry").select("id").distinct().collect() if r[0] != top)
    tree = [(-1, e, entries[2 * i + 1 : 2 * i + 3]) for i, e in enumerate(entries)]
    both = lists.select("part", "id", "neighbors").unionAll(spark.createDataFrame(tree, "part bigint, id bigint, neighbors array<bigint>"))
    merged = both.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("part", "neighbors"))).alias("lists"))
    merged = merged.select("id", F.slice(F.array_distinct(F.array_remove(F.flatten("lists.neighbors"), F.col("id"))), 1, params.degree).alias("neighbors"))
    return placed.select("id", "vec").join(merged, "id").select(F.lit(0).cast("bigint").alias("shard"), "id", (F.col("id") == top).alias("entry"), "vec", "neighbors")


# ------------------------------------------------------------- packed shards


PACKED = "shard bigint, entry int, dimension int, ids binary, vecs binary, degrees binary, links binary, label_counts binary, labels binary, codes binary"


def pack(nodes: DataFrame) -> DataFrame:
    """A row a shard of a table of nodes, with their labels (array<bigint>) and codes (array<int>) where it has these columns."""
    more = [c for c in ("labels", "codes") if c in nodes.columns]

    def make(key, t):
        ids = np.asarray(t.column("id"))
        order = np.argsort(ids, kind="stable")
        t, ids = t.take(pa.array(order)), ids[order]
        lists = t.column("neighbors").combine_chunks()
        x = matrix(t.column("vec").combine_chunks())
        flat = lambda c: t.column(c).combine_chunks() if c in more else None
        labels, codes = flat("labels"), flat("codes")
        cells = {
            "ids": ids.astype("<i8"), "vecs": x, "degrees": np.diff(np.asarray(lists.offsets)).astype("<i4"), "links": np.searchsorted(ids, np.asarray(lists.flatten())).astype("<i4"),
            "label_counts": None if labels is None else np.diff(np.asarray(labels.offsets)).astype("<i4"), "labels": None if labels is None else np.asarray(labels.flatten()).astype("<i8"),
            "codes": None if codes is None else np.asarray(codes.flatten()).astype("<u2"),
        }
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "entry": pa.array([int(np.flatnonzero(np.asarray(t.column("entry")))[0])], pa.int32()), "dimension": pa.array([x.shape[1]], pa.int32()), **{k: pa.array([None if v is None else v.tobytes()], pa.binary()) for k, v in cells.items()}})

    return nodes.select("shard", "id", "entry", "vec", "neighbors", *more).groupBy("shard").applyInArrow(make, PACKED)


class Shard:
    """A packed shard: its graph, ids, vectors, labels and codes."""

    def __init__(self, row: dict, params: IndexParams):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.x = np.frombuffer(row["vecs"], "<f8").reshape(-1, row["dimension"])
        g = self.graph = Graph.__new__(Graph)
        g.centre = self.x.mean(axis=0) if params.metric == "l2" and len(self.x) else 0.0
        g.x, g.p, g.n, g.entry, g.live = self.x - g.centre, params, len(self.x), row["entry"], np.ones(len(self.x), bool)
        g.neighbors = np.split(np.frombuffer(row["links"], "<i4").astype(np.int64), np.cumsum(np.frombuffer(row["degrees"], "<i4"))[:-1])
        self.labels = None if row["labels"] is None else np.split(np.frombuffer(row["labels"], "<i8"), np.cumsum(np.frombuffer(row["label_counts"], "<i4"))[:-1])
        self.codes = None if row["codes"] is None else np.frombuffer(row["codes"], "<u2").reshape(len(self.ids), -1).astype(np.int64)

    def allowed(self, kind: str, wanted: list[int]) -> np.ndarray | None:
        """Which vertices pass a filter of labels, as functions.labels has them."""
        if kind == "any":
            return None
        if self.labels is None:
            raise ValueError("the graph has no labels")
        own = set(wanted)
        test = {"any_of": lambda s: bool(s & own) or 0 in s, "all_of": lambda s: own <= s or 0 in s, "exact": lambda s: s == own}[kind]
        return np.array([test(set(x.tolist())) for x in self.labels], bool)


TALLY = FOUND + ", visited bigint, computed bigint"


def _searched(queries: DataFrame, nodes: DataFrame, params: IndexParams, each: Callable, query_id: str, vec: str) -> DataFrame:
    """Rows of TALLY: each(shard, queries' vectors) gives, for every query, places, distances, and the vertices visited and distances computed. A query without results has a row of null id."""
    spark = nodes.sparkSession
    packed = nodes if "links" in nodes.columns else pack(nodes)
    out = None
    for q_ids, q in query_blocks(queries, query_id, vec):
        block = spark.sparkContext.broadcast((q_ids, q))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            q_ids, q = block.value
            for b in batches:
                for k in range(b.num_rows):
                    shard = Shard(b.slice(k, 1).to_pylist()[0], params)
                    for i, (at, d, counters) in zip(q_ids.tolist(), each(shard, q)):
                        n = max(1, len(at))
                        ids = pa.array(shard.ids[at]) if len(at) else pa.nulls(1, pa.int64())
                        first = np.arange(n) == 0  # counters stand in a query's first row of the shard
                        yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), ids, pa.array(d) if len(at) else pa.nulls(1, pa.float64()), pa.array(first * counters["visited"]), pa.array(first * counters["computed"])], ["query_id", "id", "distance", "visited", "computed"])

        part = packed.mapInArrow(run, TALLY)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], TALLY)


def _beam(params: IndexParams, size: int, keep: Callable, filter: tuple, radius: float | None = None) -> Callable:
    def each(shard: Shard, q: np.ndarray) -> Iterator[tuple]:
        allowed = shard.allowed(*filter)
        for v in q:
            got, counters = shard.graph.search(v - shard.graph.centre, size, allowed, radius)
            at = np.array([u for _, u in got], np.int64)
            d = exact(params.metric, np.repeat(v[None], len(at), 0), shard.x[at])
            yield (*keep(shard.ids, at, d), counters)

    return each


def _first(k: int) -> Callable:
    def keep(ids: np.ndarray, at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids[at], d))[:k]
        return at[order], d[order]

    return keep


def search(queries: DataFrame, nodes: DataFrame, k: int, params: IndexParams = IndexParams(), beam: int | None = None, query_id: str = "query_id", vec: str = "vec", filter: tuple = ("any", [])) -> DataFrame:
    """Approximate top k of nodes or packed shards: every shard is searched, the shards' results are merged. filter: a kind of functions.labels.FILTERS and its labels; vertices that don't pass are walked through."""
    found = _searched(queries, nodes, params, _beam(params, max(beam or params.beam, k), _first(k), filter), query_id, vec)
    return ranked(found.where("id is not null").select("query_id", "id", "distance"), k)


def range_search(queries: DataFrame, nodes: DataFrame, radius: float, params: IndexParams = IndexParams(), beam: int | None = None, max_results: int = 0, query_id: str = "query_id", vec: str = "vec", filter: tuple = ("any", [])) -> DataFrame:
    """Those that a walk from each shard's entry finds within the radius (inclusive), at most max_results (0: all) a query: a beam leads to the radius, all vertices inside are expanded."""
    inside = lambda ids, at, d: (at[d <= radius], d[d <= radius])  # noqa: E731, ARG005
    reach = radius * abs(radius) if params.metric == "l2" else radius  # the kernel's distances are squared
    found = _searched(queries, nodes, params, _beam(params, beam or params.beam, inside, filter, reach), query_id, vec)
    return ranked(found.where("id is not null").select("query_id", "id", "distance"), max_results or None)


def _coded(params: IndexParams, codebook: np.ndarray, k: int, size: int) -> Callable:
    m, _, w = codebook.shape

    def each(shard: Shard, q: np.ndarray) -> Iterator[tuple]:
        g = shard.graph
        for v in q:
            table = ((v.reshape(m, 1, w) - codebook) ** 2).sum(-1)  # squared distances to each subspace's centroids
            g.dist = lambda _, rows, t=table: t[np.arange(m)[None], shard.codes[rows]].sum(1)
            got, counters = g.search(v, size, radius=-np.inf)  # all that the walk met: codes may put a near one beyond the beam
            at = np.array([u for _, u in got], np.int64)
            d = exact(params.metric, np.repeat(v[None], len(at), 0), shard.x[at])
            yield (*_first(k)(shard.ids, at, d), counters)

    return each


def search_coded(queries: DataFrame, nodes: DataFrame, codebook: np.ndarray, k: int, params: IndexParams = IndexParams(), beam: int | None = None, query_id: str = "query_id", vec: str = "vec") -> DataFrame:
    """Two stages: the graph is walked by distances of product codes, the vertices that the walk met are ordered by exact ones."""
    found = _searched(queries, nodes, params, _coded(params, codebook, k, max(beam or params.beam, k)), query_id, vec)
    return ranked(found.where("id is not null").select("query_id", "id", "distance"), k)


def search_counters(queries: DataFrame, nodes: DataFrame, params: IndexParams = IndexParams(), beam: int | None = None, codebook: np.ndarray | None = None, query_id: str = "query_id", vec: str = "vec") -> DataFrame:
    """query_id, visited (vertices expanded) and computed (distances) over all shards."""
    size = beam or params.beam
    each = _beam(params, size, _first(1), ("any", [])) if codebook is None else _coded(params, codebook, 1, size)
    return _searched(queries, nodes, params, each, query_id, vec).groupBy("query_id").agg(F.sum("visited").alias("visited"), F.sum("computed").alias("computed"))


# ---------------------------------------------------------------- changing a graph


def _kernel(t: pa.Table, params: IndexParams) -> tuple[np.ndarray, Graph]:
    """ids and the graph of a shard's nodes."""
    order = np.argsort(np.asarray(t.column("id")), kind="stable")
    t = t.take(pa.array(order))
    ids = np.asarray(t.column("id"))
    g = Graph(matrix(t.column("vec").combine_chunks()), params)
    g.neighbors = [np.searchsorted(ids, np.asarray(a.values, np.int64)) if a.is_valid and len(a) else np.zeros(0, np.int64) for a in t.column("neighbors")]
    entry = np.flatnonzero(np.asarray(t.column("entry")))
    g.entry = int(entry[0]) if len(entry) else g.entry
    return ids, g


def _nodes(shard: int, ids: np.ndarray, g: Graph) -> pa.Table:
    """Rows of a shard's live vertices."""
    at = np.flatnonzero(g.live)
    x = g.x[at] + g.centre
    return pa.table({"shard": pa.array([shard] * len(at), pa.int64()), "id": pa.array(ids[at], pa.int64()), "entry": pa.array(at == g.entry), "vec": pa.array(x.tolist(), pa.list_(pa.float64())), "neighbors": pa.array([ids[g.neighbors[v]].tolist() for v in at], pa.list_(pa.int64()))})


def _changed(nodes: DataFrame, rows: DataFrame, change: Callable) -> DataFrame:
    """nodes after change(kernel's ids, graph, a table of the shard's rows) -> ids, in each shard that has rows; rows have id and are dealt as by build."""
    shards = nodes.agg(F.max("shard")).first()[0]
    shards = 1 if shards is None else shards + 1
    keyed = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    names = [f.split()[0] for f in NODES.split(", ")]

    def both(key, left, right):
        if not right.num_rows:
            return left.select(names)
        shard = key[0].as_py()
        return _nodes(shard, *change(left, right))

    return nodes.select(*names).groupBy("shard").cogroup(keyed.groupBy("shard")).applyInArrow(both, NODES)


def insert(nodes: DataFrame, rows: DataFrame, params: IndexParams = IndexParams(), id: str = "id", vec: str = "vec") -> DataFrame:
    """nodes with new rows linked in; an id that is there already is an error."""

    def change(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, Graph]:
        new = np.asarray(right.column("id"))
        x = matrix(right.column("vec").combine_chunks())
        if left.num_rows:
            ids, g = _kernel(left, params)
            if np.isin(new, ids).any():
                raise ValueError("an id that is inserted is in the graph already")
        else:
            ids, g = np.zeros(0, np.int64), Graph(x[:0], params)
        for v in g.grow(x).tolist():
            g.insert(v)
        return np.concatenate([ids, new]), g

    return _changed(nodes, rows.select(F.col(id).cast("bigint").alias("id"), V.doubles(vec).alias("vec")), change)


def delete(nodes: DataFrame, ids: DataFrame, params: IndexParams = IndexParams(), id: str = "id") -> DataFrame:
    """nodes without the ids, whose neighbours are linked with each other; unknown ids are passed over."""

    def change(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, Graph]:
        if not left.num_rows:
            return np.zeros(0, np.int64), Graph(np.zeros((0, 1)), params)
        own, g = _kernel(left, params)
        for v in np.flatnonzero(np.isin(own, np.asarray(right.column("id")))).tolist():
            g.delete(v)
        return own, g

    return _changed(nodes, ids.select(F.col(id).cast("bigint").alias("id")), change)


def prune(nodes: DataFrame, params: IndexParams) -> DataFrame:
    """nodes whose lists are cut to the degree; edges that go are dropped in both directions."""

    def make(key, t):
        ids, g = _kernel(t, params)
        for v in range(g.n):
            g.prune_edges(v)
        return _nodes(key[0].as_py(), ids, g)

    return nodes.groupBy("shard").applyInArrow(make, NODES)


def entry_points(nodes: DataFrame) -> DataFrame:
    """shard, id of the entries."""
    return nodes.where("entry").select("shard", "id")


# --------------------------------------------------------------- about a graph


def edges(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("src"), F.explode("neighbors").alias("dst"))


def graph_stats(nodes: DataFrame) -> DataFrame:
    """One row: vertices, edges, and mean, least and greatest degree."""
    s: Column = F.size("neighbors")
    return nodes.agg(F.count(F.lit(1)).alias("n_vertices"), F.sum(s).cast("bigint").alias("n_edges"), F.avg(s).alias("avg_degree"), F.min(s).alias("min_degree"), F.max(s).alias("max_degree"))


def reachable(edges_: DataFrame, start: int, rounds: int = 1000) -> DataFrame:
    """v: vertices that paths from start reach (itself included), a round of joins a step. What is reached is appended to one table, so plans don't grow with the rounds."""
    spark = edges_.sparkSession
    e = stage(edges_.select("src", "dst").distinct(), "edges")
    path = scratch_path(spark, "reached")
    seen = lambda: spark.read.schema("v bigint").parquet(path)
    front = spark.createDataFrame([(start,)], "v bigint")
    front.write.parquet(path)
    for _ in range(rounds):
        new = e.join(front, e["src"] == front["v"], "left_semi").select(F.col("dst").alias("v")).distinct()
        front = stage(new.join(seen(), "v", "left_anti"), "front")
        if not front.limit(1).count():
            return seen()
        front.write.mode("append").parquet(path)
    raise RuntimeError(f"paths of more than {rounds} steps")


def connectivity(edges_: DataFrame, start: int, n_vertices: int) -> DataFrame:
    """One row: vertices that start reaches, and their share of all."""
    return reachable(edges_, start).agg(F.count(F.lit(1)).alias("n_reached")).withColumn("ratio", F.col("n_reached") / F.lit(n_vertices))


def topology_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: Jaccard similarity of two edge sets (src, dst)."""
    x = a.select("src", "dst").distinct().withColumn("a", F.lit(1))
    y = b.select("src", "dst").distinct().withColumn("b", F.lit(1))
    both = x.join(y, ["src", "dst"], "full")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count(F.lit(1)).alias("n_either")).withColumn("similarity", F.col("n_both") / F.col("n_either"))
