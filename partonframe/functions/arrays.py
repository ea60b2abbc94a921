"""Expressions on ragged columns: depth, flattening, mapping, distances, vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def depth(df: DataFrame, name: str) -> int:
    """How many lists the elements of a column are in; 0 for a scalar."""
    kind, n = df.schema[name].dataType, 0
    while isinstance(kind, T.ArrayType):
        kind, n = kind.elementType, n + 1
    return n


def flatten(df: DataFrame, name: str) -> Column:
    """All elements of a ragged column as one list."""
    out, n = F.col(name), depth(df, name)
    for _ in range(n - 1):
        out = F.flatten(out)
    return out if n else F.array(out)


def apply(column: Column, func: Callable[[Column], Column], depth: int) -> Column:
    """``func`` of every element that is ``depth`` lists deep."""
    return func(column) if depth == 0 else F.transform(column, lambda x: apply(x, func, depth - 1))


def apply_pair(one: Column, two: Column, func: Callable[[Column, Column], Column], depth: int) -> Column:
    return func(one, two) if depth == 0 else F.zip_with(one, two, lambda x, y: apply_pair(x, y, func, depth - 1))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def recursive_distance(one: Column, two: Column, depth: int) -> Column:
    """Sum of absolute differences of nested lists; infinite if their shapes differ."""
    if depth == 0:
        return F.abs(one.cast("double") - two.cast("double"))
    each = F.zip_with(one, two, lambda x, y: recursive_distance(x, y, depth - 1))
    return F.when(F.size(one) != F.size(two), float("inf")).otherwise(total(each))


def add_vectors(one: Column, two: Column) -> Column:
    return F.zip_with(one, two, lambda x, y: x + y)


def dot(one: Column, two: Column) -> Column:
    return total(F.zip_with(one.cast("array<double>"), two.cast("array<double>"), lambda x, y: x * y))


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def embedding_norm(vector: Column) -> Column:
    """The vector at length 1; a zero vector has no direction and gives null elements."""
    return F.transform(vector.cast("array<double>"), lambda x: F.try_divide(x, norm(vector)))


def embedding_distance2(one: Column, two: Column) -> Column:
    return total(F.zip_with(one.cast("array<double>"), two.cast("array<double>"), lambda x, y: (x - y) * (x - y)))


def embedding_root_angular2(one: Column, two: Column) -> Column:
    """The angle between two vectors."""
    cosine = F.try_divide(dot(one, two), norm(one) * norm(two))
    return F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))


def embedding_angular2(one: Column, two: Column) -> Column:
    angle = embedding_root_angular2(one, two)
    return angle * angle


def min_max_scale(value: Column, low: Column, high: Column) -> Column:
    """To [-1, 1]; null where all values are equal."""
    return F.try_divide(2.0 * (value - low), high - low) - 1.0


def soft_equal(a: Column, b: Column) -> Column:
    """Equal within 1e-8 + 1e-5 |b|, or both NaN."""
    close = F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)
    return F.when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b)).when(a == b, True).otherwise(close)


def soft_equal_lists(a: Column, b: Column) -> Column:
    """Lists of one length with softly equal elements."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, soft_equal), lambda x: x)


def generic_sort(values: Column) -> Column:
    """A list sorted by value, nulls last; nested lists by their elements."""
    return F.array_sort(values)


def to_bool(text: Column) -> Column:
    """Truth of a word: false for the usual words of no, null for None, else true."""
    word = F.lower(F.trim(text))
    return F.when(word == "none", F.lit(None).cast("boolean")).when(word.isin("false", "f", "no", "n", "0", ""), False).otherwise(True)
