"""Functions on array columns; null elements are skipped, as JVM-side higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _valid(v: Column) -> Column:
    return F.array_compact(v)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(v: Column) -> Column:
    """Sum; null if no element is valid."""
    return F.when(n_valid(v) > 0, F.aggregate(_valid(v), F.lit(0.0), lambda s, x: s + x.cast("double")))


def average(v: Column) -> Column:
    return F.try_divide(total(v), n_valid(v))


def stddev(v: Column) -> Column:
    """Sample standard deviation; 0 for fewer than two valid elements, null for none."""

    def spread(x: Column) -> Column:
        mean = F.aggregate(x, F.lit(0.0), lambda s, e: s + e.cast("double")) / F.size(x)
        return _let(mean, lambda m: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + (e.cast("double") - m) * (e.cast("double") - m)) / (F.size(x) - 1)))

    return F.when(n_valid(v) > 1, spread(_valid(v))).when(n_valid(v) == 1, F.lit(0.0))


def median(v: Column) -> Column:
    """The lower median."""
    ordered = F.array_sort(_valid(v))
    return F.when(n_valid(v) > 0, F.element_at(ordered, F.floor((n_valid(v) - 1) / 2).cast("int") + 1))


def smallest(v: Column) -> Column:
    return F.array_min(v)


def largest(v: Column) -> Column:
    return F.array_max(v)


def n_elements(v: Column) -> Column:
    return F.size(v)


def n_valid(v: Column) -> Column:
    return F.when(v.isNotNull(), F.size(_valid(v)))


def element(v: Column, *index: int | Column, dims: tuple[int, ...] = ()) -> Column:
    """The element at 1-based indices; with ``dims`` the flat array is read as a block whose first axis runs fastest. Null outside."""
    at = F.lit(0)
    stride = 1
    inside = F.lit(True)
    for k, i in enumerate(index):
        i = F.lit(i) if isinstance(i, int) else i
        if k < len(dims):
            inside = inside & (i >= 1) & (i <= dims[k])
        at = at + (i - 1) * stride
        stride *= dims[k] if k < len(dims) else 1
    return F.when(inside & (at >= 0) & (at < F.size(v)), F.get(v, at.cast("int")))


def combine(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    """Element by element; null for vectors of different length."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, body))


def resize(v: Column, n: int) -> Column:
    """The first ``n`` elements, filled up with nulls."""
    missing = F.lit(n) - F.size(v)
    kind = F.lit(None)
    return F.when(missing > 0, F.concat(v, F.array_repeat(kind, F.greatest(missing, F.lit(0))))).otherwise(F.slice(v, 1, n))
