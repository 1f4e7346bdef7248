"""Label sets (sorted distinct array<bigint>) and filters on them. Label 0 is universal: a row that has it passes any_of and all_of."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIVERSAL = 0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label_set(labels: Column | str) -> Column:
    return F.array_sort(F.array_distinct(_col(labels).cast("array<bigint>")))


def _literal(labels: Iterable[int]) -> Column:
    own = sorted(set(labels))
    return F.array(*[F.lit(x).cast("bigint") for x in own]) if own else F.expr("cast(array() as array<bigint>)")


def add(labels: Column | str, label: int) -> Column:
    return F.array_sort(F.array_union(_col(labels), _literal([label])))


def remove(labels: Column | str, label: int) -> Column:
    return F.array_remove(_col(labels), F.lit(label).cast("bigint"))


def contains(labels: Column | str, label: int) -> Column:
    return F.array_contains(_col(labels), F.lit(label).cast("bigint"))


def universal(labels: Column | str) -> Column:
    return contains(labels, UNIVERSAL)


def any_of(labels: Column | str, wanted: Iterable[int]) -> Column:
    """Shares a label with wanted, or is universal; nothing wanted: only universal rows."""
    return F.arrays_overlap(_col(labels), _literal(wanted)) | universal(labels)


def all_of(labels: Column | str, wanted: Iterable[int]) -> Column:
    """Has all wanted labels, or is universal."""
    return (F.size(F.array_except(_literal(wanted), _col(labels))) == 0) | universal(labels)


def exactly(labels: Column | str, wanted: Iterable[int]) -> Column:
    """Has these labels and no others; universal rows are no exception."""
    return label_set(labels) == _literal(wanted)


def anything(labels: Column | str) -> Column:  # noqa: ARG001
    return F.lit(True)


def matches(labels: Column | str, wanted: Iterable[int]) -> Column:
    """As any_of, but nothing wanted passes every row."""
    own = list(wanted)
    return any_of(labels, own) if own else F.lit(True)


FILTERS = {"any": anything, "any_of": any_of, "all_of": all_of, "exact": exactly}


def label_filter(kind: str, wanted: Iterable[int] = ()):
    """A predicate of a label column by name; 'any' takes no labels."""
    if kind not in FILTERS:
        raise ValueError(f"a label filter is one of {', '.join(FILTERS)}")
    own = sorted(set(wanted))
    return (lambda c: F.lit(True)) if kind == "any" else (lambda c: FILTERS[kind](c, own))


def postings(rows: DataFrame, id: str = "id", labels: str = "labels") -> DataFrame:
    """label, id."""
    return rows.select(F.explode(labels).alias("label"), F.col(id).alias("id")).distinct()


def candidates(rows: DataFrame, kind: str, wanted: Iterable[int], id: str = "id", labels: str = "labels") -> DataFrame:
    """Ids that may pass a filter, by semi-join with the postings."""
    own = sorted(set(wanted))
    post = postings(rows, id, labels)
    universal_ids = post.where(F.col("label") == UNIVERSAL).select("id")
    if kind == "any_of":
        got = post.where(F.col("label").isin([*own, UNIVERSAL])).select("id")
    elif kind == "all_of":
        got = post.where(F.col("label").isin(own)).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(own)).select("id").unionAll(universal_ids)
    elif kind == "exact":
        got = post.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label").isin(own)).alias("k")).where((F.col("n") == len(own)) & (F.col("k") == len(own))).select("id")
    else:
        raise ValueError("candidates are for any_of, all_of and exact")
    return got.distinct()


def label_stats(rows: DataFrame, labels: str = "labels") -> DataFrame:
    """One row: rows, different labels, most and mean number of labels of a row."""
    sizes = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size(labels)).cast("bigint").alias("max_labels"), F.avg(F.size(labels)).alias("avg_labels"))
    return sizes.crossJoin(rows.select(F.explode(labels).alias("l")).agg(F.countDistinct("l").alias("n_labels")))


def label_counts(rows: DataFrame, labels: str = "labels") -> DataFrame:
    return rows.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
