"""Rows of a table by id and text, where ids may be null or repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringe.session import fresh


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def take(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``chosen`` (id, text_key, copies, rows) names, each as often as ``copies`` says.

    ``rows`` is how many rows of ``docs`` share the id and text; where there are several, ``copies`` is
    meant for all of them together, and the first of them by all columns stands for all. A column of
    ``docs`` may have any name.
    """
    names = docs.columns
    w_id, w_key, w_copies, w_rows, own_key, nth, kept = fresh(names, "take_id", "take_key", "take_copies", "take_rows", "take_text", "take_nth", "take_kept")
    wanted = chosen.select(F.col("id").alias(w_id), F.col("text_key").alias(w_key), F.col("copies").alias(w_copies), F.col("rows").alias(w_rows))
    keyed = docs.withColumn(own_key, text_key(F.col(text_col)))
    met = keyed.join(wanted, F.col(own_key).eqNullSafe(F.col(w_key)) & F.col(id_col).eqNullSafe(F.col(w_id)))
    one = met.where(F.col(w_rows) == 1).drop(w_id, w_key, w_rows)
    # The largest of a hash over all columns, then of the columns themselves: partially aggregated, the same on every run.
    own = F.to_json(F.struct(*names))
    best = F.max_by(F.struct(*names), F.struct(F.xxhash64(own), own)).alias(kept)
    several = met.where(F.col(w_rows) > 1).groupBy(w_id, own_key, w_copies).agg(best).select(f"{kept}.*", own_key, w_copies)
    all_rows = one.unionByName(several).where(F.col(w_copies) > 0)
    return all_rows.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(w_copies).cast("int")))).select(*names)
