"""Selecting rows by intervals (good time intervals): a range semi-join on time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringe.operators.ordered import group_overlapping
from fringe.session import fresh

#: Buckets in which the intervals' whole span is cut.
BUCKETS = 10_000


def merge_intervals(intervals: DataFrame, start: str = "start", stop: str = "stop") -> DataFrame:
    """Overlapping and touching intervals as one; nulls and reversed ends drop out.

    An interval begins a new one if it starts after all before it have stopped; intervals are looked at in ranges,
    and what a range hands on is how far it reaches.
    """
    rows = intervals.select(F.col(start).alias("start"), F.col(stop).alias("stop")).where("start <= stop")
    return group_overlapping(rows, "start", "stop").groupBy("run").agg(F.min("start").alias(start), F.max("stop").alias(stop)).drop("run")


def in_intervals(rows: DataFrame, intervals: DataFrame, time: Column, start: str = "start", stop: str = "stop", shift: float = 0.0, inside: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """The rows whose ``time`` lies in an interval, both ends included (or in none, with ``inside=False``; a null time is in none).

    ``shift`` is added to the intervals. Intervals are merged and cut at buckets of their span, so the
    join is an equi-join on the bucket, with the ends as its condition.
    """
    spans = merge_intervals(intervals.select((F.col(start) + shift).cast("double").alias("start"), (F.col(stop) + shift).cast("double").alias("stop")))
    low, high = spans.agg(F.min("start"), F.max("stop")).first()
    how = "left_semi" if inside else "left_anti"
    width = ((high or 0.0) - (low or 0.0)) / buckets or 1.0
    place = lambda t: F.floor((t - F.lit(low or 0.0)) / F.lit(width))
    at, row_bucket, first, last, bucket = fresh(rows.columns, "row_time", "row_bucket", "gti_start", "gti_stop", "gti_bucket")
    cut = spans.withColumn(bucket, F.explode(F.sequence(place(F.col("start")), place(F.col("stop"))))).select(F.col("start").alias(first), F.col("stop").alias(last), bucket)
    met = rows.withColumns({at: time.cast("double"), row_bucket: place(time.cast("double"))})
    condition = (F.col(row_bucket) == F.col(bucket)) & (F.col(at) >= F.col(first)) & (F.col(at) <= F.col(last))
    return met.join(cut, condition, how).drop(at, row_bucket)
