"""Bit strings of any width with don't-care places, as texts of 0, 1 and x.

A shorter operand has leading zeros, which are known. Nulls, and texts of anything else, give null. Operators look at
a batch of texts as a matrix of places.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, StringType

UNKNOWN, OTHER = 2, 3
_CODES = np.full(256, OTHER, np.uint8)
_CODES[[ord(c) for c in "01xX"]] = 0, 1, UNKNOWN, UNKNOWN


def _places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's bytes and its width, and whether it is a bit string."""
    filled = pc.fill_null(texts, "").cast(pa.binary())
    sizes = pc.binary_length(filled).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = _CODES[np.frombuffer(b"".join(filled.to_pylist()), np.uint8)]
    wrong = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[codes == OTHER], minlength=len(sizes)) > 0
    return codes, sizes, ~wrong & ~texts.is_null().to_numpy(zero_copy_only=False)


def _matrix(codes: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Places to the right in rows of ``width``, zeros before them."""
    out = np.zeros((len(sizes), width), np.uint8)
    row = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    out[row, width - sizes[row] + np.arange(len(codes)) - starts[row]] = codes
    return out


def _texts(places: np.ndarray, sizes: np.ndarray, good: np.ndarray) -> pa.Array:
    """The last ``sizes`` places of each row as a text."""
    within = np.arange(places.shape[1])[None, :] >= places.shape[1] - sizes[:, None]
    letters = np.frombuffer(b"01x?", np.uint8)[places[within]]
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    out = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(letters.tobytes())])
    return pc.if_else(pa.array(good), out, pa.scalar(None, pa.string()))


def _of_two(a: Column, b: Column, kind: DataType, combine: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Column:
    """``combine`` of the matrices of both sides: a matrix for texts, else a value for each row."""

    @F.arrow_udf(kind)
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        (x, x_sizes, x_good), (y, y_sizes, y_good) = _places(left), _places(right)
        width, good = int(max([0, *x_sizes, *y_sizes])), x_good & y_good
        out = combine(_matrix(x, x_sizes, width), _matrix(y, y_sizes, width))
        return _texts(out, np.maximum(x_sizes, y_sizes), good) if out.ndim == 2 else pa.array(out, mask=~good)

    return run(a, b)


def parse(text: Column) -> Column:
    """A text of 0, 1 and x in any case as a bit string; null of any other."""
    return F.when(text.rlike("^[01xX]*$"), F.lower(text))


def both(a: Column, b: Column) -> Column:
    """Places that are 1 in both; not known where either isn't."""
    return _of_two(a, b, StringType(), lambda x, y: np.where((x == UNKNOWN) | (y == UNKNOWN), UNKNOWN, x & y))


def either(a: Column, b: Column) -> Column:
    """Places that are 1 in either; not known only where neither is."""
    return _of_two(a, b, StringType(), lambda x, y: np.where((x == 1) | (y == 1), 1, np.where((x == 0) | (y == 0), 0, UNKNOWN)))


def inverse(bits: Column) -> Column:
    """All places flipped; what isn't known stays so."""
    return F.translate(parse(bits), "01", "10")


def join(a: Column, b: Column) -> Column:
    """``a`` followed by ``b``."""
    return F.concat(parse(a), parse(b))


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x != y) & (x != UNKNOWN) & (y != UNKNOWN)


def equal(a: Column, b: Column) -> Column:
    """Whether no place that is known in both differs."""
    return _of_two(a, b, BooleanType(), lambda x, y: ~_differ(x, y).any(1))


def less(a: Column, b: Column) -> Column:
    """Whether ``a`` is the smaller number, of the places that are known in both."""

    def first(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not x.shape[1]:
            return np.zeros(len(x), bool)
        at = (np.arange(len(x)), _differ(x, y).argmax(1))
        return _differ(x, y)[at] & (x[at] < y[at])

    return _of_two(a, b, BooleanType(), first)


def less_or_equal(a: Column, b: Column) -> Column:
    return ~less(b, a)


def count_ones(bits: Column) -> Column:
    """Places that are 1."""
    return F.length(F.translate(parse(bits), "0x", ""))
