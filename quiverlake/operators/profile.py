"""Profiles of vector tables: statistics, histograms, duplicates, validation, memory, latency samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..sources.shared import stage


def placed(rows: DataFrame, by: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """rows with _end: how much weight (None: rows) its group has up to and with each row, in the order of ``order``.

    Ranges of (group, order) are sorted apart and the ranges' totals are added in front,
    so a group with most of the rows is spread over as many tasks as it fills.
    """
    ranged = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_m", F.monotonically_increasing_id())
    ranged = stage(ranged, "ranges").withColumn("_p", F.shiftright("_m", 33))  # ranges are drawn anew each time they are computed
    amount = F.col(weight) if weight else F.lit(1).cast("bigint")
    sums = ranged.groupBy("_p", *by).agg(F.sum(amount).alias("_s"), F.min("_m").alias("_from"))  # a row for each range and group in it
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("_p").alias("_q"), *[F.col(c).alias(f"_by_{c}") for c in by], "_from", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_p") == F.col("_q")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    both = ranged.join(before, same)
    if weight:
        end = F.col("_before") + F.sum(weight).over(Window.partitionBy("_p", *by).orderBy(*order, "_m"))
    else:
        end = F.col("_before") + F.col("_m") - F.col("_from") + 1
    return both.withColumn("_end", end).drop("_m", "_p", "_q", "_from", "_before", *[f"_by_{c}" for c in by])


def values(rows: DataFrame, vec: str = "vec") -> DataFrame:
    return rows.select(F.explode(V.doubles(vec)).alias("x"))


def picked(samples: DataFrame, places: dict[str, Column], value: str = "x", by: list[str] | None = None) -> DataFrame:
    """Values at given places (from 0, as an expression of n) of the samples, or of each group's, in order.

    Exact ranks come from counts of equal values, summed in order over ranges of values,
    so no task has to sort or hold all samples of a group.
    """
    by = by or []
    counts = samples.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    total = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    run = placed(counts, by, [value], "_c")
    if by:
        total = total.withColumnsRenamed({c: f"_t_{c}" for c in by})
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
        run = run.join(total, same)
    else:
        run = run.crossJoin(F.broadcast(total))  # one row
    at = lambda p: F.max(F.when((p >= F.col("_end") - F.col("_c")) & (p < F.col("_end")), F.col(value)))
    return run.groupBy(*by).agg(F.max("n").alias("n"), *[at(p).alias(k) for k, p in places.items()])


def nth(percent: int) -> Column:
    return F.floor(F.col("n") * percent / 100)


def vector_stats(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """One row: least, greatest, mean and (upper) median element, and least, greatest and mean norm."""
    x = values(rows, vec)
    a = x.agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"))
    n = rows.select(V.norm(vec).alias("n")).agg(F.min("n").alias("norm_min"), F.max("n").alias("norm_max"), F.avg("n").alias("norm_mean"))
    return a.crossJoin(picked(x, {"median": F.floor(F.col("n") / 2)}).select("median")).crossJoin(n)


def detailed_stats(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """One row: count, mean, population deviation, quartiles and high percentiles by index, and norms."""
    x = values(rows, vec)
    a = x.agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    p = picked(x, {f"p{k}": nth(k) for k in (25, 50, 75, 95, 99)}).withColumnRenamed("n", "n_values")
    n = rows.select(V.norm(vec).alias("n")).agg(F.min("n").alias("norm_min"), F.max("n").alias("norm_max"), F.avg("n").alias("norm_mean"), F.stddev_pop("n").alias("norm_std"))
    return a.crossJoin(p).crossJoin(n)


def histogram(rows: DataFrame, bins: int = 20, vec: str = "vec") -> DataFrame:
    """bin, low, high, n of equal bins from the least to the greatest element; the last is closed."""
    x = values(rows, vec)
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0))
    got = x.crossJoin(F.broadcast(ends)).select(F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / width)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"))
    return every.join(got, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def duplicate_key(vec: str = "vec") -> Column:
    """Elements to six decimals, truncated towards zero."""
    return F.transform(V.doubles(vec), lambda x: (x * 1e6).cast("bigint"))


def duplicate_groups(rows: DataFrame, id: str = "id", vec: str = "vec") -> DataFrame:
    """first_id, n of each group of equal vectors; groups of one too."""
    return rows.groupBy(duplicate_key(vec).alias("key")).agg(F.min(id).alias("first_id"), F.count(F.lit(1)).alias("n")).drop("key")


def duplicates(rows: DataFrame, id: str = "id", vec: str = "vec") -> DataFrame:
    """One row: unique vectors, groups of two or more, and vectors beyond the first of a group."""
    return duplicate_groups(rows, id, vec).agg(F.count(F.lit(1)).alias("n_unique"), F.count_if(F.col("n") > 1).alias("n_groups"), F.sum(F.col("n") - 1).alias("n_extra"))


def validate(rows: DataFrame, dimension: int, id: str = "id", vec: str = "vec") -> DataFrame:
    """One row: rows of another dimension, NaN and infinite elements, zero vectors, and the first five ids of each problem."""
    v = V.doubles(vec)
    n_nan = F.size(F.filter(v, lambda x: F.isnan(x)))
    n_inf = F.size(F.filter(v, lambda x: F.abs(x) == float("inf")))
    flagged = rows.select(F.col(id).alias("id"), (F.size(v) != dimension).alias("d"), n_nan.alias("a"), n_inf.alias("i"), (V.norm(v) == 0).alias("z"))
    five = lambda cond: F.slice(F.array_sort(F.collect_list(F.when(cond, F.col("id")))), 1, 5)
    bad = flagged.where("d or a > 0 or i > 0 or z")
    # five of each at most reach the last aggregate
    top = bad.withColumn("what", F.expr("case when d then 'd' when a > 0 then 'a' when i > 0 then 'i' else 'z' end")).withColumn("r", F.row_number().over(Window.partitionBy("what").orderBy("id"))).where("r <= 5")
    first = top.agg(five(F.col("what") == "d").alias("dimension_ids"), five(F.col("what") == "a").alias("nan_ids"), five(F.col("what") == "i").alias("infinite_ids"), five(F.col("what") == "z").alias("zero_ids"))
    sums = flagged.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("d").alias("n_dimension"), F.coalesce(F.sum("a"), F.lit(0)).alias("n_nan"), F.coalesce(F.sum("i"), F.lit(0)).alias("n_infinite"), F.count_if("z").alias("n_zero"))
    return sums.crossJoin(first)


def memory_estimates(rows: DataFrame, vec: str = "vec", edges: int = 64) -> DataFrame:
    """One row: bytes of raw vectors, of a graph of ``edges`` 8-byte neighbours, of an index in memory, and of product-quantized codes at four ratios."""
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).cast("bigint").alias("d"))
    raw = F.col("n") * F.col("d") * 4
    return s.select("n", "d", raw.alias("raw_bytes"), (F.col("n") * edges * 8).alias("graph_bytes"), (raw + F.col("n") * edges * 8 + (1 << 20)).alias("index_bytes"), *[F.floor(raw / k).alias(f"pq_bytes_{k}x") for k in (4, 8, 16, 32, 64)])


# ------------------------------------------------------------------- samples


def percentile_stats(samples: DataFrame, by: str, value: str, order: str, window: int | None = None) -> DataFrame:
    """Of each metric's last ``window`` samples: count, mean, sample deviation, extremes, interpolated percentiles."""
    samples = samples.select(by, value, order)
    if window is not None:
        n = samples.groupBy(F.col(by).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
        samples = placed(samples, [by], [order]).join(n, F.col(by).eqNullSafe(F.col("_g"))).where(F.col("_end") > F.col("_n") - window)
    samples = samples.select(by, F.col(value).cast("double").alias("x"))
    places = {}
    for p in (50, 90, 95, 99):
        at = (F.col("n") - 1) * (p / 100)
        places |= {f"l{p}": F.floor(at), f"h{p}": F.ceil(at)}
    between = lambda p: (lambda at: F.col(f"l{p}") + (F.col(f"h{p}") - F.col(f"l{p}")) * (at - F.floor(at)))((F.col("n") - 1) * (p / 100))
    picks = picked(samples, places, by=[by]).select(F.col(by).alias("_g"), *[between(p).alias(f"p{p}") for p in (50, 90, 95, 99)])
    sums = samples.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    return sums.join(picks, F.col(by).eqNullSafe(F.col("_g"))).drop("_g")


def sliding_mean(samples: DataFrame, by: str, value: str, order: str, window: int, block: int = 100_000) -> DataFrame:
    """Each sample with the mean of the last ``window`` samples of its metric; a metric is cut into blocks, each with the last samples of the one before."""
    block = max(block, window)
    rows = placed(samples.select(by, order, value), [by], [order]).withColumn("_b", F.floor((F.col("_end") - 1) / block))
    late = (F.col("_end") - 1) % block >= block - (window - 1)
    rows = rows.withColumn("_k", F.explode(F.when(late, F.array(F.col("_b"), F.col("_b") + 1)).otherwise(F.array(F.col("_b")))))
    w = Window.partitionBy(by, "_k").orderBy("_end").rowsBetween(-(window - 1), 0)
    out = rows.select(by, order, F.avg(value).over(w).alias("mean"), F.count(F.lit(1)).over(w).alias("n"), (F.col("_b") == F.col("_k")).alias("_own"))
    return out.where("_own").drop("_own")


def latency_report(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Of each metric: mean, p50, p90, p95 and p99 by index, and operations per second of one worker (values are microseconds)."""
    p = picked(samples.select(by, F.col(value).alias("x")), {"p50": F.floor(F.col("n") / 2), "p90": nth(90), "p95": nth(95), "p99": nth(99)}, by=[by])
    sums = samples.groupBy(F.col(by).alias("_g")).agg(F.avg(value).alias("mean"), F.sum(value).alias("total"))
    return p.join(sums, F.col(by).eqNullSafe(F.col("_g"))).select(by, "n", "mean", "p50", "p90", "p95", "p99", (F.col("n") * 1e6 / F.col("total")).alias("per_second"))


def throughput(samples: DataFrame, by: str, ts: str, seconds: int) -> DataFrame:
    """Operations per second of each interval, each with its own count."""
    at = (F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds) * seconds).alias("start")
    return samples.groupBy(by, at).agg(F.count(F.lit(1)).alias("n")).withColumn("per_second", F.col("n") / seconds)
