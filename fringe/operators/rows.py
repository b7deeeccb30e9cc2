"""Selecting rows, calculating and editing columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringe.operators.ordered import last_values

Ranges = Sequence[tuple[int, int]]


def flag_rows(rows: DataFrame, condition: Column, alias: str = "good") -> DataFrame:
    """``rows`` with whether they meet ``condition``; null counts as no."""
    return rows.withColumn(alias, F.coalesce(condition, F.lit(False)))


def select_rows(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.where(condition)


def first_row(rows: DataFrame, condition: Column, order: str) -> DataFrame:
    """The first row that meets ``condition`` in the order of ``order``; no row if none does."""
    return rows.where(condition).orderBy(order).limit(1)


def row_ranges(text: str) -> Ranges:
    """``"10-20, 30-35, 50"`` as pairs; ``"-5"`` begins at 1 and ``"7-"`` has no end. Ranges rise and don't overlap."""
    out: list[tuple[int, int]] = []
    for part in filter(None, map(str.strip, text.split(","))):
        found = re.fullmatch(r"(\d*)\s*(-?)\s*(\d*)", part)
        if not found or not (found[1] or found[3]):
            raise ValueError(f"not a row range: {part!r}")
        low = int(found[1] or 1)
        high = int(found[3]) if found[3] else (2**62 if found[2] else low)
        if high < low or low < 1 or (out and low <= out[-1][1]):
            raise ValueError(f"row ranges must rise: {part!r}")
        out.append((low, high))
    return out


def in_ranges(row: Column, ranges: Ranges) -> Column:
    held = F.lit(False)
    for low, high in ranges:
        held = held | row.between(low, high)
    return held


def delete_rows(rows: DataFrame, row: str, ranges: Ranges) -> DataFrame:
    return rows.where(~in_ranges(F.col(row), ranges))


def calculate(rows: DataFrame, name: str, value: Column, row: str | None = None, ranges: Ranges | None = None) -> DataFrame:
    """``value`` as column ``name``, in all rows or in those of ``ranges``; elsewhere an old column keeps its values and a new one is null."""
    if ranges is None:
        return rows.withColumn(name, value)
    old = F.col(name) if name in rows.columns else F.lit(None)
    return rows.withColumn(name, F.when(in_ranges(F.col(row), ranges), value).otherwise(old))


def result_type(rows: DataFrame, value: Column) -> str:
    """The type that an expression has over these rows, without reading them."""
    return rows.select(value.alias("x")).dtypes[0][1]


def matching(names: Sequence[str], pattern: str) -> list[str]:
    """Names that fit, whatever their case: ``*`` any characters, ``?`` one, ``#`` one or more digits."""
    wanted = "".join({"*": ".*", "?": ".", "#": r"\d+"}.get(c, re.escape(c)) for c in pattern)
    return [n for n in names if re.fullmatch(wanted, n, re.IGNORECASE)]


def keep_columns(rows: DataFrame, *patterns: str) -> DataFrame:
    kept = {n for p in patterns for n in matching(rows.columns, p)}
    return rows.select(*[n for n in rows.columns if n in kept])


def drop_columns(rows: DataFrame, *patterns: str) -> DataFrame:
    return rows.drop(*{n for p in patterns for n in matching(rows.columns, p)})


def rename_columns(rows: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return rows.withColumnsRenamed(dict(names))


def scale_column(x: Column, scale: float = 1.0, zero: float = 0.0, null_value: float | None = None) -> Column:
    """Physical value of a stored one: scaled and shifted, the stored null value as null."""
    stored = x if null_value is None else F.nullif(x, F.lit(null_value))
    return stored * scale + zero


def housekeeping(rows: DataFrame, time: str, name: str, value: str, names: Sequence[str], condition: Column | None = None) -> DataFrame:
    """Long (time, name, value) rows as one row for each time with a column for each name, each name's last value carried on.

    Times are looked at in ranges, and what a range hands on is its last values.
    """
    wide = rows.where(F.col(name).isin(*names)).groupBy(time).pivot(name, list(names)).agg(F.last(value, ignorenulls=True))
    filled = last_values(wide, names, time)
    return filled if condition is None else filled.where(condition)


def append_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows one table after the other, by column name; a missing column is null."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
