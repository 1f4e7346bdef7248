"""Search results, ground truth and label lists as text or vector files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def result_lines(results: DataFrame, with_distances: bool = True) -> DataFrame:
    """query_id, line: 'query id:distance id:distance ...' in the order of ranks, six decimals."""
    cell = F.concat(F.col("id").cast("string"), F.lit(":"), F.format_string("%.6f", "distance")) if with_distances else F.col("id").cast("string")
    cells = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", cell.alias("c")))).alias("cells"))
    return cells.select("query_id", F.concat_ws(" ", F.col("query_id").cast("string"), F.array_join(F.transform("cells", lambda x: x["c"]), " ")).alias("line"))


def write_results(results: DataFrame, path: str, with_distances: bool = True) -> None:
    result_lines(results, with_distances).orderBy("query_id").select("line").write.text(path)


def parse_results(lines: DataFrame) -> DataFrame:
    """(query_id, rank, id, distance) of result lines (column line)."""
    cells = lines.select(F.split("line", " ").alias("c")).select(F.get("c", F.lit(0)).cast("bigint").alias("query_id"), F.posexplode(F.slice("c", 2, F.greatest(F.lit(0), F.size("c") - 1))).alias("p", "x"))
    at = F.split("x", ":")
    return cells.select("query_id", (F.col("p") + 1).alias("rank"), F.get(at, F.lit(0)).cast("bigint").alias("id"), F.get(at, F.lit(1)).cast("double").alias("distance"))


def result_bytes(results: DataFrame, k: int) -> DataFrame:
    """query_id, ids and distances: k little-endian unsigned 32-bit ids and 32-bit floats of each query, in the order of ranks; the missing are the largest id and infinite."""
    own = results.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "distance"))).alias("c"))
    padded = lambda f, fill, kind: F.concat(F.transform("c", lambda x: f(x)).cast(f"array<{kind}>"), F.array_repeat(F.lit(fill).cast(kind), F.lit(k) - F.size("c")))
    rows = own.select("query_id", padded(lambda x: x["id"], 0xFFFFFFFF, "bigint").alias("ids"), padded(lambda x: x["distance"], float("inf"), "float").alias("distances"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [pa.array([np.array(x, t).tobytes() for x in b.column(i).to_pylist()], pa.binary()) for i, t in ((1, "<u4"), (2, "<f4"))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cells], ["query_id", "ids", "distances"])

    return rows.mapInArrow(run, "query_id bigint, ids binary, distances binary")


def parse_result_bytes(rows: DataFrame) -> DataFrame:
    """query_id, rank, id, distance of result_bytes' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, i, d in zip(*(b.column(c).to_pylist() for c in range(3))):
                ids, dist = np.frombuffer(i, "<u4").astype(np.int64), np.frombuffer(d, "<f4").astype(float)
                ok = np.flatnonzero(ids != 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(ok), pa.int64()), pa.array((ok + 1).astype(np.int32)), pa.array(ids[ok]), pa.array(dist[ok])], ["query_id", "rank", "id", "distance"])

    return rows.select("query_id", "ids", "distances").mapInArrow(run, "query_id bigint, rank int, id bigint, distance double")


def check_count(found: DataFrame, n: int, what: str) -> DataFrame:
    """found, if it has n rows."""
    if (got := found.count()) != n:
        raise ValueError(f"{what}: {got} rows for {n} vectors")
    return found


def parse_labels(lines: DataFrame, line: str = "line", pos: str = "pos") -> DataFrame:
    """id, labels of comma-separated lists, one a line; a blank line has none."""
    parts = F.transform(F.filter(F.split(F.col(line), ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("bigint"))
    return lines.select(F.col(pos).alias("id"), F.array_sort(F.array_distinct(parts)).alias("labels"))


def ground_truth(vectors: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id from rows (pos, vec) of an ivecs file: the first k ids of each, which must be there."""
    if vectors.where(F.size("vec") < k).limit(1).count():
        raise ValueError(f"the ground truth has rows of fewer than {k} ids")
    return vectors.select(F.col("pos").alias("query_id"), F.posexplode(F.slice("vec", 1, k)).alias("p", "id")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("id").cast("bigint").alias("id"))


def write_json_report(spark: SparkSession, rows: list[dict], path: str) -> None:
    spark.createDataFrame(rows).coalesce(1).write.json(path)
