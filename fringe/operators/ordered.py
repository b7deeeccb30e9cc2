"""Running totals, differences and offsets over a total order of rows, without a window over all rows.

Rows are range-partitioned by the order, over as many partitions as shuffles have, and written to the checkpoint folder: the
bounds of ranges are sampled, and must not be drawn again. Windows run inside a partition, and what a partition hands on to the
next (its total, its last value, its row count) is one row for each.

Rows that are equal in the order follow one another by a hash of all their columns, which gives the same result on every run.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fringe.session import checkpointed, fresh


class _Ranged:
    """Rows in ranges: ``rows`` with columns ``part`` and ``tie``, and windows within a range."""

    def __init__(self, rows: DataFrame, order: str | Sequence[str], **values: Column) -> None:
        self.columns = rows.columns
        self.order = [order] if isinstance(order, str) else list(order)
        names = fresh(self.columns, "part", "tie", "carried", "own", *values)
        self.part, self.tie, self.carried, self.own, *rest = names
        self.names = dict(zip(values, rest, strict=True))
        # Maps can't be hashed, nor what holds them.
        hashed = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in rows.schema]
        made = rows.withColumns({self.names[k]: v for k, v in values.items()} | {self.tie: F.xxhash64(*hashed)})
        # The tie is part of the range, so that equal rows don't gather in one partition.
        self.rows = checkpointed(made.repartitionByRange(*self.order, self.tie).withColumn(self.part, F.spark_partition_id()))
        self.within = Window.partitionBy(self.part).orderBy(*self.order, self.tie)
        self.between = Window.orderBy(self.part)

    def carry(self, value: Column, empty, rows: DataFrame | None = None, fold=F.sum) -> DataFrame:
        """``rows`` with the sum (or other ``fold``) of ``value`` over all earlier ranges, as ``carried``: one row for each range goes through one task."""
        rows = self.rows if rows is None else rows
        sums = rows.groupBy(self.part).agg(fold(value).alias(self.own))
        before = fold(F.col(self.own)).over(self.between.rowsBetween(Window.unboundedPreceding, -1))
        return rows.join(F.broadcast(sums.select(self.part, F.coalesce(before, F.lit(empty)).alias(self.carried))), self.part)

    def result(self, rows: DataFrame, alias: str, value: Column) -> DataFrame:
        return rows.select(*[F.col(c) for c in self.columns if c != alias], value.alias(alias))


def accumulate(rows: DataFrame, value: Column, order: str | Sequence[str], alias: str = "accum") -> DataFrame:
    """``rows`` with the running sum of ``value`` up to and with each row; a null adds nothing."""
    ranged = _Ranged(rows, order, value=value)
    own = F.col(ranged.names["value"])
    upto = F.sum(own).over(ranged.within.rowsBetween(Window.unboundedPreceding, 0))
    return ranged.result(ranged.carry(own, 0), alias, F.col(ranged.carried) + F.coalesce(upto, F.lit(0)))


def accumulate_vectors(rows: DataFrame, vector: Column, order: str | Sequence[str], alias: str = "accum") -> DataFrame:
    """``rows`` with, in each place of an array of numbers, the running sum over all elements before it: within its row and in all earlier rows. A null element adds nothing."""
    ranged = _Ranged(rows, order, vector=vector)
    own = F.col(ranged.names["vector"])
    total = F.aggregate(F.coalesce(own, F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))
    before = F.coalesce(F.sum(total).over(ranged.within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.col(ranged.carried)
    met = ranged.carry(total, 0.0).withColumn(ranged.own, before)

    @F.arrow_udf("array<double>")
    def running(vectors: pa.Array, starts: pa.Array) -> pa.Array:
        """Each vector's running sums, all in one pass over the batch."""
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        upto = np.concatenate(([0.0], np.cumsum(pc.fill_null(vectors.flatten(), 0.0).to_numpy(zero_copy_only=False))))
        first = ends - sizes
        # Small vectors of small numbers keep their digits: a row's sums begin anew from its own start.
        flat = upto[1:] - np.repeat(upto[first], sizes) + np.repeat(starts.to_numpy(zero_copy_only=False), sizes)
        return pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(flat), mask=vectors.is_null())

    return ranged.result(met, alias, running(own.cast("array<double>"), F.col(ranged.own)))


def last_values(rows: DataFrame, columns: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """``rows`` with the nulls of ``columns`` filled by the last value before them."""
    ranged = _Ranged(rows, order)
    within = ranged.within.rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*ranged.order, ranged.tie)
    lasts = ranged.rows.groupBy(ranged.part).agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns])
    earlier = ranged.between.rowsBetween(Window.unboundedPreceding, -1)
    carried = dict(zip(columns, fresh([*ranged.rows.columns], *[f"last_{c}" for c in columns]), strict=True))
    before = lasts.select(ranged.part, *[F.last(c, ignorenulls=True).over(earlier).alias(carried[c]) for c in columns])
    filled = ranged.rows.join(F.broadcast(before), ranged.part)
    return filled.select(*[F.coalesce(F.last(c, ignorenulls=True).over(within), F.col(carried[c])).alias(c) if c in carried else F.col(c) for c in ranged.columns])


def group_overlapping(rows: DataFrame, start: str, stop: str, alias: str = "run") -> DataFrame:
    """``rows`` with the number of the run that an interval is in: one that starts after all before it have stopped begins a new run."""
    ranged = _Ranged(rows, [start, stop])
    met = ranged.carry(F.col(stop), None, fold=F.max)
    reach = F.greatest(F.col(ranged.carried), F.max(stop).over(ranged.within.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.when(F.coalesce(F.col(start) <= reach, F.lit(False)), 0).otherwise(1)
    opened = checkpointed(met.withColumn(ranged.own, opens).drop(ranged.carried).withColumnRenamed(ranged.own, alias))
    numbered = ranged.carry(F.col(alias), 0, opened)
    return ranged.result(numbered, alias, F.col(ranged.carried) + F.sum(alias).over(ranged.within.rowsBetween(Window.unboundedPreceding, 0)))


def number_rows(rows: DataFrame, order: str | Sequence[str], alias: str = "row") -> DataFrame:
    """``rows`` with their number from 1 in the order of ``order``."""
    ranged = _Ranged(rows, order)
    return ranged.result(ranged.carry(F.lit(1), 0), alias, F.col(ranged.carried) + F.row_number().over(ranged.within))


def sequence_difference(rows: DataFrame, value: Column, order: str | Sequence[str], alias: str = "seqdiff") -> DataFrame:
    """``rows`` with ``value`` minus that of the row before; the first row's own value; null where either is null."""
    ranged = _Ranged(rows, order, value=value)
    own = F.struct(F.col(ranged.names["value"]).alias("value"))
    last = ranged.rows.groupBy(ranged.part).agg(F.max_by(own, F.struct(*ranged.order, ranged.tie)).alias(ranged.own))
    before = last.select(ranged.part, F.lag(ranged.own).over(ranged.between).alias(ranged.carried))
    met = ranged.rows.join(F.broadcast(before), ranged.part)
    met = met.withColumn(ranged.own, F.coalesce(F.lag(own).over(ranged.within), F.col(ranged.carried)))
    mine = F.col(ranged.names["value"])
    return ranged.result(met, alias, F.when(F.col(ranged.own).isNull(), mine).otherwise(mine - F.col(ranged.own)["value"]))


def row_offset(rows: DataFrame, column: str, offset: int, order: str | Sequence[str], alias: str = "shifted") -> DataFrame:
    """``rows`` with the value that ``column`` has ``offset`` rows further; null beyond the table's ends."""
    row, other_row, value = fresh([*rows.columns, alias], "row", "other_row", "other_value")
    numbered = checkpointed(number_rows(rows, order, row))
    other = numbered.select((F.col(row) - offset).alias(other_row), F.col(column).alias(value))
    met = numbered.join(other, F.col(row) == F.col(other_row), "left")
    return met.select(*[F.col(c) for c in rows.columns if c != alias], F.col(value).alias(alias))


@dataclass(frozen=True)
class Carried:
    """State that goes from chunk to chunk: of no rows, of a chunk's rows alone, and of two stretches one behind the other."""

    empty: Any
    of_chunk: Callable[[pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]


def work_in_chunks(
    rows: DataFrame, order: str | Sequence[str], work: Callable[[pd.DataFrame, int, int, Any], tuple[pd.DataFrame, bool]], schema: str, chunk_rows: int = 10_000, carried: Carried | None = None
) -> DataFrame:
    """What ``work`` makes of the rows in chunks of consecutive ones: rows of ``schema``, up to the chunk in which it asks to stop.

    ``work(chunk, first, total, state)`` gets a chunk's rows in order, the number (from 0) of its first row in the whole table,
    the number of all rows, and the state of all rows before it; it gives its result and whether to stop. Chunks are
    worked on in all ranges at once: a range's first number and state are those of the ranges before it, of which one
    row each reaches the driver, as many as shuffles have partitions. What was made behind the first stop is
    dropped, so the result is that of a loop from the first row on. Rows that are equal in the order follow one another by a hash.
    """
    ranged = _Ranged(rows, order)
    columns, part = ranged.columns, ranged.part
    sorted_ = ranged.rows.sortWithinPartitions(part, *ranged.order, ranged.tie)

    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
        """Each range's rows in chunks of ``chunk_rows``."""
        held: list[pd.DataFrame] = []
        size, own = 0, None
        for frame in frames:
            for number, rows_ in frame.groupby(part, sort=True):
                while len(rows_):
                    if own != number and held:
                        yield own, pd.concat(held)[columns]
                        held, size = [], 0
                    own, take = number, rows_.iloc[: chunk_rows - size]
                    held, size, rows_ = [*held, take], size + len(take), rows_.iloc[len(take) :]
                    if size == chunk_rows:
                        yield own, pd.concat(held)[columns]
                        held, size = [], 0
        if held:
            yield own, pd.concat(held)[columns]

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, list] = {}
        for number, chunk in chunks(frames):
            total = totals.setdefault(number, [0, carried.empty if carried else None])
            total[0] += len(chunk)
            if carried:
                total[1] = carried.merge(total[1], carried.of_chunk(chunk))
        yield pd.DataFrame([(number, n, pickle.dumps(state)) for number, (n, state) in totals.items()], columns=["part", "n", "state"])

    starts: dict[int, tuple[int, Any]] = {}
    total, state = 0, carried.empty if carried else None
    for r in sorted(sorted_.mapInPandas(summed, "part int, n long, state binary").collect(), key=lambda r: r.part):
        starts[r.part] = (total, state)
        total += r.n
        if carried:
            state = carried.merge(state, pickle.loads(r.state))
    sent = rows.sparkSession.sparkContext.broadcast((starts, total))
    first_, stop_ = fresh([f.name for f in StructType.fromDDL(schema)], "chunk_first", "chunk_stop")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[int, tuple[int, Any]] = {}
        begun, all_rows = sent.value
        stopped: set[int] = set()
        for number, chunk in chunks(frames):
            first, before = at.get(number, begun[number])
            if number in stopped:
                continue
            out, stop = work(chunk, first, all_rows, before)
            if stop:
                stopped.add(number)
            yield out.assign(**{first_: first, stop_: False})
            if stop:
                yield pd.DataFrame({first_: [first], stop_: [True]}).reindex(columns=[*out.columns, first_, stop_])
            at[number] = (first + len(chunk), carried.merge(before, carried.of_chunk(chunk)) if carried else None)

    made = checkpointed(sorted_.mapInPandas(run, f"{schema}, {first_} long, {stop_} boolean"))
    last = made.where(F.col(stop_)).agg(F.min(first_)).first()[0]
    kept = made.where(~F.col(stop_))
    return (kept if last is None else kept.where(F.col(first_) <= last)).drop(first_, stop_)
