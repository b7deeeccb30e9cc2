"""Bit strings with don't-care places, as a value and a mask of the places that are known.

A literal like ``10x1`` becomes two integers; comparisons look at the known places of both sides, and
a shorter side has leading zeros.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(bits: str) -> tuple[int, int]:
    """Value and known-mask of a string of 0, 1 and x."""
    return int("".join("1" if b == "1" else "0" for b in bits) or "0", 2), int("".join("0" if b in "xX" else "1" for b in bits) or "0", 2) | ~((1 << len(bits)) - 1) & 0x7FFFFFFFFFFFFFFF


def equal(a: Column, bits: str) -> Column:
    """Whether an integer agrees with ``bits`` in all known places."""
    value, known = literal(bits)
    return a.bitwiseXOR(F.lit(value)).bitwiseAND(F.lit(known)) == 0


def both(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def either(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def inverse(a: Column, width: int) -> Column:
    """All ``width`` places flipped."""
    return F.bitwise_not(a).bitwiseAND(F.lit((1 << width) - 1))


def count_ones(a: Column) -> Column:
    return F.bit_count(a)


def join(a: Column, b: Column, b_width: int) -> Column:
    """``a`` followed by ``b``."""
    return F.shiftleft(a, b_width).bitwiseOR(b)
