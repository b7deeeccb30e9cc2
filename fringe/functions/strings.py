"""String functions with their own null rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def str_mid(s: Column, start: int | Column, length: int | Column) -> Column:
    """``length`` characters from the 1-based ``start``: null for start 0, empty past the end."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.lit(length) if isinstance(length, int) else length
    return F.when(start > 0, F.substring(s, start, length))


def str_find(s: Column, part: str | Column) -> Column:
    """1-based place of ``part``; null where it isn't found."""
    part = F.lit(part) if isinstance(part, str) else part
    return F.nullif(F.instr(s, part), F.lit(0))
