"""Scalar functions whose null rules differ from Spark's own.

Outside its domain a function gives null, division and remainder by zero give null, and integer
division truncates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Doubles closer than this are approximately equal.
APPROX = 1e-7
SPEED_OF_LIGHT = 299792458.0


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def safe_div(a: Column, b: Column) -> Column:
    """Double quotient; null for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def int_div(a: Column, b: Column) -> Column:
    """Integer quotient, truncated towards zero; null for a zero divisor."""
    a, b = a.cast("long"), b.cast("long")
    # The least whole number has no opposite: its quotient by -1 is null.
    return F.when(b == -1, F.try_subtract(F.lit(0).cast("long"), a)).when(b != 0, F.call_function("div", a, b))


def int_mod(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign; null for a zero divisor."""
    return F.try_mod(a, b)


def int_power(a: Column, b: Column) -> Column:
    """Power of integers, truncated to an integer."""
    return F.pow(a.cast("double"), b.cast("double")).try_cast("long")


def to_int(x: Column) -> Column:
    """Truncation towards zero."""
    return x.try_cast("long")


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5): -2.5 gives -2."""
    return F.floor(x + 0.5).cast("double")


def round_half_away(x: Column) -> Column:
    """Half away from zero: -2.5 gives -3."""
    return F.round(x)


def arcsin(x: Column) -> Column:
    return F.when(F.abs(x) <= 1, F.asin(x))


def arccos(x: Column) -> Column:
    return F.when(F.abs(x) <= 1, F.acos(x))


def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def approx_equal(a: Column, b: Column) -> Column:
    return F.abs(a - b) < APPROX


def in_range(x: Column, low: Column, high: Column) -> Column:
    """Both ends belong to the range."""
    return (low <= x) & (x <= high)


def near(x: Column, centre: Column, tolerance: Column) -> Column:
    return F.abs(x - centre) < tolerance


def if_else(condition: Column, yes: Column, no: Column) -> Column:
    """Null for a null condition."""
    return F.when(condition, yes).when(~condition, no)


def least_of(a: Column, b: Column) -> Column:
    """The smaller; a null side is ignored."""
    return F.least(a, b)


def greatest_of(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _uniform(seeds: np.ndarray, draw: int) -> np.ndarray:
    """A number in (0, 1) of each seed for each draw, by scrambling both."""
    x = seeds.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * draw + 1) * np.uint64(0xD1342543DE82EF95)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53 + 2.0**-54


def _log_factorial(k: np.ndarray) -> np.ndarray:
    """By Stirling's series, after some steps up where it would be too short."""
    n = k + 1.0
    less = np.zeros_like(n)
    for _ in range(8):
        low = n < 8
        less += np.where(low, np.log(n), 0.0)
        n = np.where(low, n + 1, n)
    return (n - 0.5) * np.log(n) - n + 0.5 * np.log(2 * np.pi) + 1 / (12 * n) - 1 / (360 * n**3) - less


def poisson_numbers(means: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A Poisson number for each mean (none negative), all rows together: small means by summing chances, large ones by a transformed rejection."""
    out = np.zeros(len(means))
    small = np.flatnonzero(means < 30)
    left, chance = _uniform(seeds[small], 0), np.exp(-means[small])
    k = 0
    while len(small):
        left = left - chance
        more = left > 0
        small, left = small[more], left[more]
        k += 1
        out[small] = k
        chance = chance[more] * means[small] / k
        if k > 300:  # what is left of the chance is below the precision of the numbers
            break
    open_, draw = np.flatnonzero(means >= 30), 0
    while len(open_):
        mean = means[open_]
        b = 0.931 + 2.53 * np.sqrt(mean)
        a = -0.059 + 0.02483 * b
        u, v = _uniform(seeds[open_], 2 * draw + 1) - 0.5, _uniform(seeds[open_], 2 * draw + 2)
        us = 0.5 - np.abs(u)
        k = np.floor((2 * a / us + b) * u + mean + 0.43)
        quick = (us >= 0.07) & (v <= 0.9277 - 3.6224 / (b - 2))
        maybe = (k >= 0) & ~((us < 0.013) & (v > us))
        slow = np.log(v * (1.1239 + 1.1328 / (b - 3.4)) / (a / (us * us) + b)) <= k * np.log(mean) - mean - _log_factorial(np.maximum(k, 0))
        taken = quick | (maybe & slow)
        out[open_[taken]] = k[taken]
        open_, draw = open_[~taken], draw + 1
    return out.astype(np.int64)


def poisson(mean: Column, seed: Column) -> Column:
    """A Poisson number for each row, the same on every run for one seed column; null for a negative or null mean."""

    @F.arrow_udf(LongType())
    def draw(means: pa.Array, seeds: pa.Array) -> pa.Array:
        m = pc.fill_null(means, -1.0).to_numpy(zero_copy_only=False)
        good = m >= 0
        return pa.array(poisson_numbers(np.where(good, m, 0.0), seeds.to_numpy(zero_copy_only=False)), mask=~good)

    return draw(mean.cast("double"), F.coalesce(seed.cast("long"), F.lit(0)))
