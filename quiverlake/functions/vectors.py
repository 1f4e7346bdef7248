"""Column builders over vectors (array columns): distances, element types, scaling, scalar quantization.

Arithmetic is in double. Nothing here is a UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "inner_product")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(v: Column | str) -> Column:
    """The vector as array<double>."""
    return _col(v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2_squared(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(l2_squared(a, b))


def norm(a: Column | str) -> Column:
    return F.sqrt(total(F.transform(doubles(a), lambda x: x * x)))


def inner_product(a: Column | str, b: Column | str) -> Column:
    """The inner-product distance: the negated dot product."""
    return -dot(a, b)


def cosine(a: Column | str, b: Column | str) -> Column:
    """1 - cosine, with the cosine held in [-1, 1]; 1 if a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def distance(metric: str | Callable[[Column, Column], Column], a: Column | str, b: Column | str) -> Column:
    """By name, or by a function of two array columns."""
    if callable(metric):
        return metric(_col(a), _col(b))
    try:
        return {"l2": l2, "cosine": cosine, "inner_product": inner_product}[metric](a, b)
    except KeyError:
        raise ValueError(f"metric is one of {', '.join(METRICS)}") from None


def distance_squared(metric: str, a: Column | str, b: Column | str) -> Column:
    if metric == "l2":
        return l2_squared(a, b)
    d = distance(metric, a, b)
    return d * d


def ranking(metric: str | Callable, a: Column | str, b: Column | str) -> Column:
    """A cheaper value of the same order as the distance."""
    return l2_squared(a, b) if metric == "l2" else distance(metric, a, b)


def same_dimension(a: Column | str, dimension: int) -> Column:
    """The vector, or an error if its dimension differs."""
    return F.when(F.size(_col(a)) == dimension, _col(a)).otherwise(F.raise_error(F.lit(f"dimension is not {dimension}")))


# ------------------------------------------------------------- element types


def _held(v: Column | str, low: int, high: int, kind: str) -> Column:
    return F.transform(doubles(v), lambda x: F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.round(x))).cast(kind))


def to_int8(v: Column | str) -> Column:
    """Rounded half away from zero, held in [-128, 127]."""
    return _held(v, -128, 127, "tinyint")


def to_uint8(v: Column | str) -> Column:
    """Rounded half away from zero, held in [0, 255]; smallint, as Spark has no unsigned byte."""
    return _held(v, 0, 255, "smallint")


def to_float16(v: Column | str) -> Column:
    """Rounded to half precision (nearest, ties to even), as float: Spark has no smaller type. Beyond 65519.99 infinite."""

    def half(x: Column) -> Column:
        size = F.abs(x)
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.when(size > 0, size).otherwise(1.0))), F.lit(-14).cast("bigint")).cast("double") - 10)
        near = F.rint(x / step) * step
        return F.when(F.isnan(x) | (size == 0), x).when(F.abs(near) > 65504, F.signum(x) * float("inf")).otherwise(near).cast("float")

    return F.transform(doubles(v), half)


def scale(v: Column | str, s: Column | float, o: Column | float) -> Column:
    return F.transform(doubles(v), lambda x: x * s + o)


def scale_params(v: Column | str, low: float, high: float) -> Column:
    """struct(scale, offset) of the affine map of the vector's range to [low, high]; scale 1 if all elements are equal."""
    a = doubles(v)
    least, most = F.array_min(a), F.array_max(a)
    s = F.when(most > least, (F.lit(float(high)) - low) / (most - least)).otherwise(F.lit(1.0))
    return F.struct(s.alias("scale"), (F.lit(float(low)) - least * s).alias("offset"))


def apply_params(v: Column | str, p: Column) -> Column:
    return F.transform(doubles(v), lambda x: x * p["scale"] + p["offset"])


def invert_params(v: Column | str, p: Column) -> Column:
    return F.transform(doubles(v), lambda x: (x - p["offset"]) / p["scale"])


def quantize_int8(v: Column | str, p: Column) -> Column:
    """By the vector's own params for [-127, 127]."""
    return _held(apply_params(v, p), -127, 127, "tinyint")


def quantize_uint8(v: Column | str, p: Column) -> Column:
    """By the vector's own params for [0, 255]."""
    return _held(apply_params(v, p), 0, 255, "smallint")


def quantize_global(v: Column | str, low: Column, high: Column, signed: bool) -> Column:
    """By a range of the whole table: (x - low) / (high - low) * 255, less 128 if signed, held in range and truncated."""
    a, b = (-128.0, 127.0) if signed else (0.0, 255.0)
    width = F.when(high > low, high - low).otherwise(F.lit(1.0))
    return F.transform(doubles(v), lambda x: F.greatest(F.lit(a), F.least(F.lit(b), (x - low) / width * 255.0 + a)).cast("int"))


def normalize(v: Column | str, least: float = 1e-8) -> Column:
    """Divided by its norm if that is over ``least``."""
    a = doubles(v)
    return F.transform(F.array(norm(a)), lambda n: F.when(n > least, F.transform(a, lambda x: x / n)).otherwise(a))[0]


def preview(v: Column | str, dims: int = 8) -> Column:
    return F.slice(_col(v), 1, dims)


def subvectors(v: Column | str, m: int, width: int) -> Column:
    """m slices of ``width`` elements."""
    a = doubles(v)
    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.slice(a, i * width + 1, F.lit(width)))


def file_size_text(n: int) -> str:
    """B, KB, MB or GB with two decimals."""
    size = float(n)
    for unit in ("B", "KB", "MB"):
        if size < 1024:
            return f"{size:.2f} {unit}"
        size /= 1024
    return f"{size:.2f} GB"
