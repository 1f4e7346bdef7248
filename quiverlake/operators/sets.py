"""Sets of numbers as tables of one column x, and maps as tables of k and v."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of(df: DataFrame, values: Iterable[int]) -> DataFrame:
    """A set of given values, in df's session."""
    return df.sparkSession.createDataFrame([(int(v),) for v in set(values)], "x bigint")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("x").unionAll(b.select("x")).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("x").intersect(b.select("x"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("x").distinct().join(b.select("x"), "x", "left_anti")


def insert(a: DataFrame, values: Iterable[int]) -> DataFrame:
    return union(a, of(a, values))


def remove(a: DataFrame, values: Iterable[int]) -> DataFrame:
    return difference(a, of(a, values))


def contains(a: DataFrame, values: Iterable[int]) -> DataFrame:
    """x, present of each value that is asked for."""
    have = a.select(F.col("x").alias("_x")).distinct()
    asked = of(a, values)
    return asked.join(have, asked["x"] == F.col("_x"), "left").select("x", F.col("_x").isNotNull().alias("present"))


def put(table: DataFrame, more: DataFrame) -> DataFrame:
    """The map k, v with more's pairs in the place of its own; of several pairs of more with one key, the largest value."""
    new = more.groupBy("k").agg(F.max("v").alias("v"))
    return table.join(new.select("k"), "k", "left_anti").select("k", "v").unionAll(new)


def get(table: DataFrame, keys: Iterable[int]) -> DataFrame:
    """k, v of the keys that are there."""
    return table.where(F.col("k").isin([int(k) for k in keys])).select("k", "v")
