"""Exact quantiles of groups of any size, by narrowing ranges of values.

A pass counts each group's values in equal parts of the range that holds the wanted rank, and narrows the
range to the part that holds it; counts are aggregated before they are shuffled. Groups whose range is down
to one value are done, those with few rows in it are sorted. All groups narrow together, in a few passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringe.session import checkpointed

#: Parts of a range, and rows of a group that are sorted.
PARTS, FEW = 1_024, 10_000
_LARGEST = 1.7976931348623157e308


def exact_quantile(rows: DataFrame, keys: Sequence[str], value: str, share: float = 0.5, alias: str = "quantile", parts: int = PARTS, few: int = FEW) -> DataFrame:
    """``keys, alias``: for each group the smallest value that at least ``share`` of its values don't exceed (the lower median for a half).

    Nulls and NaN are left out, and a group of nothing else has no row; infinite values count as the largest
    finite ones. Keys are not null.
    """
    keys = list(keys)
    own = F.col(value).cast("double")
    held = rows.where(own.isNotNull() & ~F.isnan(own)).select(*keys, F.least(F.greatest(own, F.lit(-_LARGEST)), F.lit(_LARGEST)).alias("v"))
    held = checkpointed(held)
    rank = F.greatest(F.ceil(F.col("inside") * F.lit(share)), F.lit(1))
    state = held.groupBy(*keys).agg(F.count("*").alias("inside"), F.min("v").alias("low"), F.max("v").alias("high")).withColumn("rank", rank)
    state = checkpointed(state)
    done = state.where(F.lit(False))
    while True:
        wide = (F.col("inside") > few) & (F.col("low") < F.col("high"))
        done, state = checkpointed(done.unionByName(state.where(~wide))), checkpointed(state.where(wide))
        if state.isEmpty():
            break
        met = held.join(state, keys).where("v between low and high")
        # Halves, as the difference of the ends may be beyond the largest number.
        part = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * parts), F.lit(parts - 1))
        counts = met.groupBy(*keys, "rank", part.alias("part")).agg(F.count("*").alias("inside"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("inside").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        state = counts.withColumn("upto", upto).where("upto >= rank and upto - inside < rank").select(*keys, "inside", "low", "high", (F.col("rank") - F.col("upto") + F.col("inside")).alias("rank"))
        state = checkpointed(state)
    one = done.where("low = high").select(*keys, F.col("low").alias(alias))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("v"))
    sorted_ = held.join(done.where("low < high"), keys).where("v between low and high").withColumn("place", place).where("place = rank")
    return one.unionByName(sorted_.select(*keys, F.col("v").alias(alias)))
