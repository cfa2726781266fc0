"""Column expressions for ARRAY<DOUBLE> vectors (all JVM-side)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, functions as F


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def norm2(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def with_value(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, also where ``fn`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def unit(a: Column) -> Column:
    """Vector over its L2 norm; a zero vector has NULL entries."""
    return with_value(norm2(a), lambda n: F.transform(a, lambda v: F.try_divide(v, n)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm2(a) * norm2(b))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda u, v: u - v)


def zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0), n.cast("int"))


def one_hot(position: Column, size: int) -> Column:
    """Position is 0-based."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == position).cast("int"))


def pad_front(a: Column, length: Column | int) -> Column:
    """Zeros in front up to ``length``; longer arrays stay as they are."""
    length = length if isinstance(length, Column) else F.lit(length)
    return F.concat(zeros(F.greatest(length - F.size(a), F.lit(0))), a)


def reduce_window(a: Column, how: str = "last", index: int = 0) -> Column:
    """One value of a window: last, first, mean, or the 0-based ``index``."""
    if how == "last":
        return F.try_element_at(a, F.lit(-1))
    if how == "first":
        return F.get(a, F.lit(0))
    if how == "index":
        return F.get(a, F.lit(index))
    if how == "mean":
        return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), F.size(a))
    raise ValueError(f"unknown reduction {how!r}")


def vector_sum(x: Column) -> Column:
    """Aggregate: elementwise sum of arrays, combined on the map side."""
    return vector_to_array(Summarizer.sum(array_to_vector(doubles(x))))


def vector_mean(x: Column) -> Column:
    """Aggregate: elementwise mean of arrays, combined on the map side."""
    return vector_to_array(Summarizer.mean(array_to_vector(doubles(x))))
