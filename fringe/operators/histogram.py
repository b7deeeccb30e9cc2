"""Weighted histograms over one to four axes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of an axis whose size isn't given.
DEFAULT_BINS = 10


@dataclass(frozen=True)
class Axis:
    """A numeric column with limits and bin size.

    Given limits hold their lower end and not the upper; a missing limit is the column's own, and the
    last bin then also holds the greatest value. For an ``integer`` axis limits are values, each in the middle of a bin:
    both belong to it. A missing size is a tenth of the range, 1 at most. ``single`` computes bins in single precision.
    """

    column: str
    low: float | None = None
    high: float | None = None
    size: float | None = None
    integer: bool = False
    single: bool = False


def resolve(rows: DataFrame, axes: Sequence[Axis]) -> list[tuple[Axis, float, float, int]]:
    """Each axis with the lower edge, bin size and number of bins; one pass over the data where limits are missing."""
    open_axes = [a for a in axes if a.low is None or a.high is None]
    found = rows.agg(*[f(a.column).alias(f"{n}{i}") for i, a in enumerate(open_axes) for n, f in (("low", F.min), ("high", F.max))]).first() if open_axes else None
    out = []
    for a in axes:
        i = open_axes.index(a) if a in open_axes else None
        low = float(found[f"low{i}"] or 0) if a.low is None else float(a.low)
        high = float(found[f"high{i}"] or 0) if a.high is None else float(a.high)
        size = float(a.size) if a.size else min(1.0, (high - low) / DEFAULT_BINS) or 1.0
        if a.integer:
            out.append((a, low - 0.5, size, int((high - low) / size + 1)))
        else:
            n = (high - low) / size
            bins = int(n) if n == int(n) else int(n) + 1
            out.append((a, low, size, max(1, bins + (1 if a.high is None and n == int(n) else 0))))
    return out


def bin_of(axis: Axis, low: float, size: float, bins: int) -> Column:
    """The bin from 0; null for a null value and one outside."""
    kind = "float" if axis.single else "double"
    place = F.floor((F.col(axis.column).cast(kind) - F.lit(low).cast(kind)) / F.lit(size).cast(kind)).cast("long")
    inside = (F.col(axis.column).cast(kind) >= F.lit(low).cast(kind)) & (place < bins)
    if not axis.integer and axis.high is not None:
        inside = inside & (F.col(axis.column).cast(kind) < F.lit(float(axis.high)).cast(kind))
    return F.when(inside, place)


def histogram(rows: DataFrame, axes: Sequence[Axis], weight: Column | None = None, reciprocal: bool = False, where: Column | None = None, cast: str | None = None) -> DataFrame:
    """``bin_1 .. bin_n, total, n`` for every bin that a row falls in.

    ``total`` is the sum of the weights, of their reciprocals with ``reciprocal`` (a zero weight adds nothing), or the number of rows; ``cast``
    casts each row's weight first. The selection is part of the same pass.
    """
    if not 1 <= len(axes) <= 4:
        raise ValueError("one to four axes")
    if where is not None:
        rows = rows.where(F.coalesce(where, F.lit(False)))
    names = [f"bin_{i + 1}" for i in range(len(axes))]
    binned = rows.select(*[bin_of(*r).alias(n) for r, n in zip(resolve(rows, axes), names, strict=True)], (F.lit(1) if weight is None else weight).alias("weight")).dropna(subset=names)
    amount = F.try_divide(F.lit(1.0), F.col("weight").cast("double")) if reciprocal else F.col("weight")
    return binned.groupBy(*names).agg(F.sum(amount.cast(cast) if cast else amount).alias("total"), F.count("*").alias("n"))
