"""Transforms of whole vector tables: centring, normalising, global scalar quantization, positional cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .profile import values


def center(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """vec less the mean of each dimension (one array is broadcast)."""
    means = rows.select(F.posexplode(V.doubles(vec)).alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("_means"))
    return rows.crossJoin(F.broadcast(means)).withColumn(vec, F.zip_with(V.doubles(vec), "_means", lambda x, m: x - m)).drop("_means")


def normalize(rows: DataFrame, vec: str = "vec") -> DataFrame:
    return rows.withColumn(vec, V.normalize(vec))


def global_range(rows: DataFrame, method: str = "minmax", vec: str = "vec") -> DataFrame:
    """One row (low, high): the extremes, or mean -/+ three population deviations."""
    x = values(rows, vec)
    if method == "minmax":
        return x.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    if method == "standard":
        return x.agg((F.avg("x") - 3 * F.stddev_pop("x")).alias("low"), (F.avg("x") + 3 * F.stddev_pop("x")).alias("high"))
    raise ValueError("method is minmax or standard")


def quantize(rows: DataFrame, method: str = "minmax", signed: bool = True, vec: str = "vec") -> DataFrame:
    out = rows.crossJoin(F.broadcast(global_range(rows, method, vec).withColumnsRenamed({"low": "_low", "high": "_high"})))
    return out.withColumn(vec, V.quantize_global(vec, F.col("_low"), F.col("_high"), signed)).drop("_low", "_high")


def skip_limit(rows: DataFrame, skip: int, limit: int | None, id: str = "id") -> DataFrame:
    """Rows in the order of id after the first ``skip``; an error if there are no more."""
    if skip and rows.count() <= skip:
        raise ValueError("nothing is left after skip")
    out = rows.orderBy(id).offset(skip)
    return out if limit is None else out.limit(limit)


def convert(rows: DataFrame, dtype: str, vec: str = "vec") -> DataFrame:
    """Element type by name: float32, float16, int8 or uint8."""
    to = {"float32": lambda v: F.col(v).cast("array<float>"), "float16": V.to_float16, "int8": V.to_int8, "uint8": V.to_uint8}
    aliases = {"float": "float32", "f32": "float32", "f16": "float16", "i8": "int8", "u8": "uint8"}
    return rows.withColumn(vec, to[aliases.get(dtype, dtype)](vec))
