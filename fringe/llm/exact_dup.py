"""Exact duplicates, with heavy digests answered in the map stage.

Texts are equal when they are identical after every run of ASCII white space has become one space.

1. Documents are read once; each text's SHA-256 is written with the row's id, without the text.
2. A Misra-Gries summary of ``COUNTERS`` counters goes over the digests: Spark's frequent-items sketch, in which
   a full set of counters is lowered by its median. Summaries are merged in two levels, so that no
   task receives those of all tasks.
3. Its candidates are counted exactly. A digest that holds over one row in ``HEAVY_PARTS`` is sure to be a
   candidate, and there are fewer than ``HEAVY_PARTS`` of them: these verified winners are broadcast, and
   their rows are answered where they are read.
4. All other digests have few rows each; they are shuffled by digest.

Everything is made of DataFrame and SQL functions.

Nulls and edges: a null text is an empty one; of equal texts the row with the smallest id stays, a null id
last; of several rows with that id one stays; an empty table gives no rows; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import take, text_key
from .scratch import materialize

WHITE_SPACE = "[\\x20\\x09-\\x0D]+"
#: Counters of the summary, whose error is then below rows / 4,681; a candidate is sure above twice that.
COUNTERS = 10_000
HEAVY_PARTS = 2_000
#: Summaries of the first level that are merged into one of the second.
MERGED = 1_000


def text_sha256(text: Column) -> Column:
    """Lowercase hex digest of the text with white space made single; a null text counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " "), 256)


def frequent(rows: DataFrame, item: str, counters: int = COUNTERS, merged: int = MERGED) -> DataFrame:
    """Rows ``<item>``: the candidates of a Misra-Gries summary, at most ``counters`` of them."""
    parts = rows.select(item, F.floor(F.spark_partition_id() / merged).alias("part"))
    first = parts.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(`{item}`, {counters})").alias("summary"))
    # Grouped, though there is one group: summaries of partitions without rows can't be combined.
    whole = first.groupBy(F.floor(F.col("part") / 2**40)).agg(F.expr(f"approx_top_k_combine(summary, {counters})").alias("summary"))
    found = whole.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {counters})")).alias("found"))
    return found.select(F.col("found.item").alias(item))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written rows id, text_key, digest, item (the digest's first 64 bits) and a number that is the row's own."""
    hashed = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_key"), F.unhex(text_sha256(F.col(text_col))).alias("digest"))
    return materialize(hashed.withColumn("item", F.xxhash64("digest")).withColumn("row", F.monotonically_increasing_id()), "digests")


def _answers(digests: DataFrame, counters: int, heavy_parts: int) -> DataFrame:
    """``digests`` with ``first`` (unnamed, id, row: the row that stays) and ``size`` of each row's group."""
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")
    total = digests.count()
    candidates = frequent(digests, "item", counters)
    met = digests.join(F.broadcast(candidates), "item", "left_semi")
    verified = met.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("size"))
    winners = materialize(verified.where((F.col("size") > 1) & (F.col("size") * heavy_parts > total)), "winners")
    heavy = digests.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    light = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti").withColumns({"first": F.min(order).over(same), "size": F.count("*").over(same)})
    return heavy.unionByName(light)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, heavy_parts: int = HEAVY_PARTS) -> DataFrame:
    """Rows ``<id_col>, keep_id, group_size, kept, text_sha256`` for every row of ``docs`` (module docstring)."""
    out = _answers(_digests(docs, id_col, text_col), counters, heavy_parts)
    return out.select(F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, heavy_parts: int = HEAVY_PARTS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, its text as it was."""
    digests = _digests(docs, id_col, text_col)
    kept = _answers(digests, counters, heavy_parts).where(F.col("row") == F.col("first.row")).select("id", "text_key")
    # Rows that share id and text are told apart by ``take``.
    same = digests.groupBy("id", "text_key").agg(F.count("*").alias("rows")).select(F.col("id").alias("s_id"), F.col("text_key").alias("s_key"), "rows")
    chosen = kept.join(same, F.col("text_key").eqNullSafe(F.col("s_key")) & F.col("id").eqNullSafe(F.col("s_id")))
    return take(docs, chosen.select("id", "text_key", F.lit(1).cast("long").alias("copies"), "rows"), id_col, text_col)


def oracle() -> str:
    """The same over ``documents`` as DuckDB SQL."""
    return r"""
    with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as digest from documents)
    select doc_id, min(doc_id) over (partition by digest) as keep_id, count(*) over (partition by digest) as group_size,
        row_number() over (partition by digest order by doc_id nulls last) = 1 as kept, digest as text_sha256 from d"""
