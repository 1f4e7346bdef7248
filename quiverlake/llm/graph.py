"""Connected components of an edge table, without any vertex's neighbours in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """v, comp (the smallest vertex of v's component) for every vertex of the edges (bigint).

    Each round takes the smallest label among the neighbours and then follows labels
    (pointer jumping), which makes the rounds logarithmic in a component's diameter. The
    minima are partial before they are dealt by vertex; a hub's edges meet its label in
    one partition of the join, two numbers an edge, which adaptive execution splits.
    """
    e = edges.select(F.col(a).alias("s"), F.col(b).alias("d")).where("s <> d")
    e = stage(e.union(e.select("d", "s")).distinct(), "edges")
    lab = stage(e.groupBy("s").agg(F.min("d").alias("m")).select(F.col("s").alias("v"), F.least("s", "m").alias("comp")), "labels")
    for _ in range(rounds):
        near = e.join(lab.select("v", "comp"), F.col("s") == F.col("v")).groupBy("d").agg(F.min("comp").alias("m"))
        new = lab.select("v", "comp").join(near, F.col("v") == near["d"], "left").select("v", F.least("comp", F.coalesce("m", "comp")).alias("c1"), F.col("comp").alias("old"))
        hop = lab.select(F.col("v").alias("hv"), F.col("comp").alias("hc"))
        new = new.join(hop, new["c1"] == hop["hv"], "left").select("v", F.least("c1", F.coalesce("hc", "c1")).alias("comp"), "old")
        new = stage(new, "labels")
        discard(lab)
        if new.where("comp <> old").limit(1).count() == 0:
            discard(e)
            return new.select("v", "comp")
        lab = new
    raise RuntimeError("components did not converge")
