"""A vector table as one object: rows, a graph over them, product codes, and what one does with them.

Everything it holds is a DataFrame; changes give a new object. On disk it is a folder
of Parquet tables: ``rows`` (id, vec, labels), ``graph`` (nodes), ``shards`` (packed,
what searches read), and ``about`` (parameters and the codebook as JSON). A whole graph,
one of all rows however many, isn't packed beyond ``shard_rows``: searches are exact then.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import vectors as V
from ..sources.shared import stage
from . import graph, knn, pq


@dataclass(frozen=True)
class VectorTable:
    rows: DataFrame  # id, vec and, if there are any, labels
    params: graph.IndexParams = graph.IndexParams()
    nodes: DataFrame | None = None
    shards: DataFrame | None = None
    codebook: np.ndarray | None = None
    pq_params: pq.Params | None = None
    shard_rows: int = 20_000
    whole: bool = False  # one graph of all rows, not one a shard

    @property
    def metric(self) -> str:
        return self.params.metric

    # ------------------------------------------------------------ making one

    def with_graph(self, shard_rows: int | None = None, whole: bool | None = None) -> VectorTable:
        n, whole = shard_rows or self.shard_rows, self.whole if whole is None else whole
        build = graph.build_whole if whole else graph.build
        return replace(self, shard_rows=n, whole=whole, nodes=stage(build(self.rows, self.params, n), "graph"))._packed()

    def with_codes(self, params: pq.Params) -> VectorTable:
        book, _ = pq.train(self.rows, params)
        out = replace(self, codebook=book, pq_params=params)
        return out._packed() if self.nodes is not None else out

    def coded(self) -> DataFrame:
        if self.codebook is None:
            raise ValueError("the table has no codebook")
        return pq.encode(self.rows.withColumn("vec", V.doubles("vec")), self.codebook)

    def _packed(self) -> VectorTable:
        if self.whole and self.size() > self.shard_rows:
            return replace(self, shards=None)
        nodes = self.nodes
        if "labels" in self.rows.columns:
            nodes = nodes.join(self.rows.select(F.col("id").alias("_l"), "labels"), F.col("id") == F.col("_l"), "left").drop("_l").withColumn("labels", F.coalesce("labels", F.expr("cast(array() as array<bigint>)")))
        if self.codebook is not None:
            nodes = pq.encode(nodes, self.codebook)
        return replace(self, shards=stage(graph.pack(nodes), "shards"))

    # --------------------------------------------------------------- searches

    def search(self, queries: DataFrame, k: int, beam: int | None = None, filter: str = "any", labels: tuple[int, ...] = (), exact: bool = False) -> DataFrame:
        """query_id, id, rank, distance: through the graph where there is one, else (or if asked) exactly."""
        if exact or self.shards is None:
            return knn.topk_join(queries, self._passing(filter, labels), k, self.metric)
        return graph.search(queries, self.shards, k, self.params, beam, filter=(filter, list(labels)))

    def search_coded(self, queries: DataFrame, k: int, beam: int | None = None) -> DataFrame:
        """In two stages, on the codes and then on the vectors."""
        if self.codebook is None or self.shards is None:
            raise ValueError("two-stage search takes a graph and codes")
        return graph.search_coded(queries, self.shards, self.codebook, k, self.params, beam)

    def counters(self, queries: DataFrame, beam: int | None = None, coded: bool = False) -> DataFrame:
        """query_id, visited, computed of a search through the graph."""
        return graph.search_counters(queries, self.shards, self.params, beam, self.codebook if coded else None)

    def range_search(self, queries: DataFrame, radius: float, max_results: int = 0, beam: int | None = None, filter: str = "any", labels: tuple[int, ...] = (), exact: bool = False) -> DataFrame:
        if exact or self.shards is None:
            return knn.range_join(queries, self._passing(filter, labels), radius, self.metric, max_results)
        return graph.range_search(queries, self.shards, radius, self.params, beam, max_results, filter=(filter, list(labels)))

    def _passing(self, kind: str, labels: tuple[int, ...]) -> DataFrame:
        return self.rows if kind == "any" else self.rows.where(L.label_filter(kind, labels)(F.col("labels")))

    # ---------------------------------------------------------------- changes

    def insert(self, rows: DataFrame) -> VectorTable:
        """With more rows (of ids that aren't there), linked into the graph."""
        new = rows.select(*self.rows.columns)
        if self.rows.join(new.select(F.col("id").alias("_n")), F.col("id") == F.col("_n"), "left_semi").limit(1).count():
            raise ValueError("an id that is inserted is in the table already")
        out = replace(self, rows=stage(self.rows.unionByName(new), "rows"))
        if self.nodes is not None and self.whole:
            return out.with_graph()
        return out if self.nodes is None else replace(out, nodes=stage(graph.insert(self.nodes, new, self.params), "graph"))._packed()

    def delete(self, ids: DataFrame) -> VectorTable:
        """Without the ids (column id), also in the graph."""
        out = replace(self, rows=stage(knn.without(self.rows, ids), "rows"))
        if self.nodes is not None and self.whole:
            return out.with_graph()
        return out if self.nodes is None else replace(out, nodes=stage(graph.delete(self.nodes, ids, self.params), "graph"))._packed()

    # ------------------------------------------------------------------- about

    def size(self) -> int:
        return self.rows.count()

    def dimension(self) -> int:
        first = self.rows.select(F.size("vec").alias("d")).first()
        return first["d"] if first else 0

    def stats(self) -> DataFrame:
        """One row: rows, dimension, shards, edges, degrees and bytes of vectors, lists and codes."""
        out = self.rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dimension"))
        if self.nodes is not None:
            g = graph.graph_stats(self.nodes).select("n_edges", "avg_degree", "max_degree")
            out = out.crossJoin(F.broadcast(g)).crossJoin(F.broadcast(self.nodes.agg(F.countDistinct("shard").alias("n_shards"))))  # one row each
        else:
            out = out.select("*", *[F.lit(0).cast(t).alias(c) for c, t in (("n_edges", "bigint"), ("avg_degree", "double"), ("max_degree", "int"), ("n_shards", "bigint"))])
        code_bytes = 0 if self.pq_params is None else self.pq_params.m * (1 if self.pq_params.bits <= 8 else 2)
        return out.select("*", (F.col("n_rows") * F.col("dimension") * 4).alias("vector_bytes"), (F.col("n_edges") * 4).alias("graph_bytes"), (F.col("n_rows") * code_bytes).alias("code_bytes"))

    # -------------------------------------------------------------------- disk

    def save(self, path: str) -> None:
        spark = self.rows.sparkSession
        about = {"params": asdict(self.params), "shard_rows": self.shard_rows, "whole": self.whole, "graph": self.nodes is not None, "packed": self.shards is not None, "codebook": None if self.codebook is None else pq.to_json(self.codebook, self.pq_params)}
        self.rows.write.parquet(f"{path}/rows")
        if self.nodes is not None:
            self.nodes.write.parquet(f"{path}/graph")
        if self.shards is not None:
            self.shards.write.parquet(f"{path}/shards")
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.parquet(f"{path}/about")  # last: a folder without it isn't whole

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorTable:
        about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
        read = lambda name, there: spark.read.parquet(f"{path}/{name}") if there else None
        book, p = pq.from_json(about["codebook"]) if about["codebook"] else (None, None)
        return VectorTable(spark.read.parquet(f"{path}/rows"), graph.IndexParams(**about["params"]), read("graph", about["graph"]), read("shards", about.get("packed", about["graph"])), book, p, about["shard_rows"], about.get("whole", False))
