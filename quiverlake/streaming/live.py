"""A vector table that changes: operations, the live view, consolidation, and the same as a stream.

Operations are rows (seq, op, id, vec, labels) with op 'insert', 'delete' or
'set_labels'. The last operation of an id wins; an insert after a delete revives
it. Ids don't change; consolidation gives dense new ids in a column of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators import knn
from ..sources.shared import stage

OPS = "seq bigint, op string, id bigint, vec array<float>, labels array<bigint>"


def last_ops(ops: DataFrame) -> DataFrame:
    """The state of each id: one row, with partial aggregation before the shuffle."""
    placed = ops.where(F.col("op").isin("insert", "delete"))
    state = placed.groupBy("id").agg(F.max_by(F.struct("op", "vec", "labels", "seq"), "seq").alias("s"))
    relabelled = ops.where(F.col("op") == "set_labels").groupBy(F.col("id").alias("_id")).agg(F.max_by(F.struct("labels", "seq"), "seq").alias("r"))
    both = state.join(relabelled, state["id"] == relabelled["_id"], "left")
    labels = F.when(F.col("r.seq") > F.col("s.seq"), F.col("r.labels")).otherwise(F.col("s.labels"))
    return both.select("id", F.col("s.op").alias("op"), F.col("s.vec").alias("vec"), labels.alias("labels"), F.greatest(F.col("s.seq"), F.coalesce(F.col("r.seq"), F.col("s.seq"))).alias("seq"))


def live(ops: DataFrame) -> DataFrame:
    return last_ops(ops).where(F.col("op") == "insert").select("id", "vec", "labels")


def tombstones(ops: DataFrame) -> DataFrame:
    return last_ops(ops).where(F.col("op") == "delete").select("id")


def rejected(ops: DataFrame) -> DataFrame:
    """seq, id of the deletions of ids that weren't live at the time: unknown, or deleted already."""
    before = F.lag("op").over(Window.partitionBy("id").orderBy("seq"))
    placed = ops.where(F.col("op").isin("insert", "delete")).select("seq", "id", "op", before.alias("_b"))
    return placed.where((F.col("op") == "delete") & F.coalesce(F.col("_b") != "insert", F.lit(True))).select("seq", "id")


def search(queries: DataFrame, ops: DataFrame, k: int, metric: str = "l2", **names) -> DataFrame:
    """The k nearest live rows: deleted ones are never found."""
    return knn.topk_join(queries, live(ops), k, metric, **names)


def stats(ops: DataFrame) -> DataFrame:
    """One row: live and deleted ids, and fragmentation (deleted over all)."""
    s = last_ops(ops).agg(F.count_if(F.col("op") == "insert").alias("n_live"), F.count_if(F.col("op") == "delete").alias("n_deleted"))
    return s.withColumn("fragmentation", F.when(F.col("n_live") + F.col("n_deleted") > 0, F.col("n_deleted") / (F.col("n_live") + F.col("n_deleted"))).otherwise(F.lit(0.0)))


def consolidate(ops: DataFrame) -> DataFrame:
    """The live rows with dense new_id in the order of id: ranks within ranges of ids, then the ranges' offsets."""
    rows = live(ops)
    placed = rows.repartitionByRange("id").sortWithinPartitions("id").withColumn("_m", F.monotonically_increasing_id())
    placed = placed.withColumn("_p", F.shiftright("_m", 33)).withColumn("_r", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    placed = stage(placed, "consolidated")  # ranges are drawn anew each time they are computed, so they are computed once
    # a row a partition
    before = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return placed.join(F.broadcast(before), F.col("_p") == F.col("_q")).select("id", (F.col("_b") + F.col("_r")).alias("new_id"), "vec", "labels")


class LiveTable:
    """Versions of the live table in a folder; a batch of operations makes the next version.

    Each version holds every id's last operation, deletions too until they are
    over ``max_fragmentation`` of all; then they are left out. Operations may come
    late as long as their deletions are held; a stream whose files come out of
    order needs ``max_fragmentation=1``.
    """

    def __init__(self, spark: SparkSession, path: str, max_fragmentation: float = 0.2):
        self.spark, self.path, self.limit = spark, path.rstrip("/"), max_fragmentation

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        done = lambda p: fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(where) if s.getPath().getName().startswith("v") and done(s.getPath()))

    def state(self) -> DataFrame:
        v = self._versions()
        return self.spark.read.schema(OPS).parquet(f"{self.path}/v{v[-1]}") if v else self.spark.createDataFrame([], OPS)

    def read(self) -> DataFrame:
        """The last committed version's live rows."""
        return self.state().where(F.col("op") == "insert").select("id", "vec", "labels")

    def search(self, queries: DataFrame, k: int, metric: str = "l2", **names) -> DataFrame:
        """The k nearest of the last version's live rows."""
        return knn.topk_join(queries, self.read(), k, metric, **names)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all versions but the last ``keep``; readers of older ones must be done."""
        jvm = self.spark._jvm
        for v in self._versions()[: -max(1, keep)]:
            where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def apply(self, ops: DataFrame, version: int | None = None) -> None:
        """A batch of operations; a version that is there already is left (a batch may come again)."""
        have = self._versions()
        version = (have[-1] + 1 if have else 0) if version is None else version
        if version in have:
            return
        merged = last_ops(self.state().unionByName(ops.select("seq", "op", "id", "vec", "labels"))).select("seq", "op", "id", "vec", "labels")
        s = merged.agg(F.count_if(F.col("op") == "delete").alias("d"), F.count(F.lit(1)).alias("n")).first()
        if s["n"] and s["d"] / s["n"] > self.limit:
            merged = merged.where(F.col("op") == "insert")
        merged.write.mode("overwrite").parquet(f"{self.path}/v{version}")

    def follow(self, ops: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Applies a stream of operations, a micro-batch a version."""
        writer = ops.writeStream.foreachBatch(lambda batch, i: self.apply(batch, i)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
