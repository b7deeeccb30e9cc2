"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash and queued, as often as a source may repeat. A queued
copy finishes at virtual time (words of its source up to and with it) / (the source's target): all
sources together then run at the rates of their targets. The copies are range-sorted by finish time
and the queue is cut where the words reach the budget.

Sizes are summed in two steps (hash buckets of a source, then documents of a bucket), so a source
that holds most rows is spread like the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import take, text_key
from .scratch import materialize

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BUCKET_ROWS = 2_000
WORD = "[^\\x20\\x09-\\x0D]+"
_BITS = 52


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sources`` (source, source_size, ...) with rank, weight and target.

    Sources by code point, null last, get the weights in turn. The budget is the sum of all sizes. A
    source's target is its share by weight, ``max_repeats`` times its size at most; what is cut off is
    shared among the others again, until none is above. That fixed point is found at once: ordered by
    size / weight the capped sources come first, and a source is capped if the share left to it and
    those after it exceeds its cap. One row for each source goes through one task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    chosen = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("weight", chosen).withColumn("cap", max_repeats * F.col("source_size").cast("double"))
    every = Window.orderBy("ratio", "rank")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    out = (
        ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()))
        .withColumn("left_size", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("capped", F.col("left_size") * F.col("weight") >= F.col("cap") * F.col("left_weight"))
    )
    share = F.min(F.when(~F.col("capped"), F.struct("ratio", "rank", (F.col("left_size") / F.col("left_weight")).alias("share")))).over(Window.partitionBy()).getField("share")
    return out.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(share * F.col("weight"))).select("source", "source_size", "rows", "rank", "weight", "target", "budget")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    bucket_rows: int = BUCKET_ROWS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """A row for each document: id, size, source_size, target, taken, source, copies, and the ``keep`` columns.

    Rows of one id fall in different hash buckets unless their texts are equal too. ``copies`` is how often the mix holds the document, ``taken`` the words in those copies; over all
    they fill the budget to less than a document of each source. The order, and so the result, depends on ids
    and sizes alone. A null text has size 0; documents of size 0 are never taken; a null source is a
    source; rows that share an id are queued one after the other, repeated rows each for themselves; an empty
    table gives no rows.
    """
    own = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("/"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    shuffled = F.conv(F.substring(F.md5(own), 1, _BITS // 4), 16, 10).cast("long")
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), shuffled.alias("r"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    sized = materialize(sized, "sized")
    by_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights, max_repeats)
    by_source = materialize(by_source, "sources")
    named = by_source.select(F.col("source").alias("own"), "rank", "source_size", "target", "rows", "budget")

    buckets = F.ceil(F.col("rows") / bucket_rows)
    docs = sized.join(named, F.col("source").eqNullSafe(F.col("own"))).withColumn("bucket", F.floor(F.col("r") / (F.lit(float(2**_BITS)) / buckets)))
    sums = docs.groupBy("rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("rank").alias("s_rank"), F.col("bucket").alias("s_bucket"), before.alias("before"))
    placed = docs.join(sums, (F.col("rank") == F.col("s_rank")) & (F.col("bucket") == F.col("s_bucket")))
    within = F.sum("size").over(Window.partitionBy("rank", "bucket").orderBy("r", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    placed = materialize(placed.withColumn("upto", F.col("before") + within).drop("own", "s_rank", "s_bucket", "before", "bucket", "r", "rows"), "placed")

    queue = placed.where("size > 0 and target > 0").select("rank", "source_size", "target", "budget", "size", "upto", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("epoch"))
    place = F.col("epoch") * F.col("source_size") + F.col("upto")
    queue = queue.select("rank", "budget", "size", place.alias("place"), (place / F.col("target")).alias("finish"))
    order = ["finish", "rank", "place"]
    ranged = materialize(queue.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "queue")
    parts = ranged.groupBy("part").agg(F.sum("size").alias("part_size"), F.max("budget").alias("budget"))
    upto = F.sum("part_size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.select("part", "budget", upto.alias("end"), (upto - F.col("part_size")).alias("start"))
    met = ranged.drop("budget").join(parts.where("start < budget"), "part")
    whole = met.where("end <= budget").select("rank", "place")
    # The part in which the budget ends, a range partition, is the only one that is summed row by row.
    running = F.col("start") + F.sum("size").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    last = met.where("end > budget").withColumn("running", running).where("running <= budget").select("rank", "place")
    cut = whole.unionByName(last).groupBy("rank").agg(F.max("place").alias("cut"))

    out = placed.join(cut.withColumnRenamed("rank", "c_rank"), F.col("rank") == F.col("c_rank"), "left")
    copies = F.when((F.col("size") > 0) & (F.col("cut") >= F.col("upto")), F.least(F.lit(max_repeats), F.expr("(cut - upto) div source_size + 1"))).otherwise(0).cast("int")
    return out.withColumn("copies", copies).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("source").alias(source_col), "copies", *[F.col(f"keep_{c}").alias(c) for c in keep]
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each copy taken.

    Only sizes go through the queue; the texts are joined to its result by id and text. Null texts and those
    of size 0 are never taken; rows of one id and text are taken together, the first of them by all columns
    as often as all of them were; other columns may have any name; an empty table gives no rows.
    """
    keyed = docs.withColumn("text_key", text_key(F.col(text_col)))
    out = mix_sources(keyed, id_col, text_col, keep=["text_key"], **options)
    chosen = out.groupBy(F.col(id_col).alias("id"), "text_key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    return take(docs, chosen.where("copies > 0"), id_col, text_col)


def oracle(weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> str:
    """The same over ``documents`` as DuckDB SQL, in one pass of windows for each step."""
    chosen = f"list_extract({list(map(int, weights))}, cast(rank % {len(weights)} + 1 as int))::double"
    return rf"""
    with a as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
        cast('0x' || substr(md5(concat(coalesce(cast(doc_id as varchar), ''), '/', md5(coalesce(text, '')))), 1, {_BITS // 4}) as bigint) as r from documents),
    s as (select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) - 1 as rank from a group by source),
    t as (select *, {chosen} as weight, {max_repeats} * source_size::double as cap from s),
    u as (select *, sum(source_size::double) over () as budget,
        sum(source_size::double) over () - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0) as left_size,
        sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0) as left_weight from t),
    v as (select *, left_size * weight >= cap * left_weight as capped from u),
    w as (select *, case when capped then cap else weight * (select left_size / left_weight from v where not capped order by cap / weight, rank limit 1) end as target from v),
    d as (select a.doc_id, a.size, a.r, w.rank, w.source, w.source_size, w.target, w.budget,
        sum(a.size) over (partition by w.rank order by a.r, a.doc_id nulls first, a.size rows unbounded preceding)::bigint as upto from a join w on a.source is not distinct from w.source),
    q as (select rank, size, budget, e * source_size + upto as place, (e * source_size + upto) / target as finish from d, range({max_repeats}) g(e) where size > 0 and target > 0),
    c as (select rank, max(place) as cut from (select *, sum(size) over (order by finish, rank, place rows unbounded preceding) as running from q) where running <= budget group by rank),
    o as (select d.*, case when size > 0 and cut >= upto then least({max_repeats}, (cut - upto) // source_size + 1) else 0 end as copies from d left join c using (rank))
    select doc_id, size, source_size, target, cast(copies * size as bigint) as taken, source, cast(copies as int) as copies from o"""
