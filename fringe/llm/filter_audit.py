"""How document filters interact: what each removes in every order in which they can be applied.

Five filters fail a document (words are maximal runs without ASCII white space, case-sensitive):

- A: under 100 words;
- B: 100 * distinct words < 80 * words;
- C: 100 * ASCII capitals > 10 * code points;
- D: holds any of ``#$%&*|``;
- E: identical to the text of a smaller id anywhere in the table.

1. One pass over the texts gives each row its failures A to D, its length in code points and hashes of its
   blocks, the first of 256 code points and each further one of fifteen times what lies before it.
2. Duplicates by partition refinement: rows are split by length, then by one block hash after the other;
   whatever is alone in its class drops out. A class that holds over one row in ``HOT_PARTS`` meets its
   rows by broadcast (there are fewer than ``HOT_PARTS`` such classes), the others by a shuffle.
3. The texts of the classes that are left are read and compared whole: they are grouped by text itself. In
   each group all ids but the smallest fail E. Should different texts share a class, their rows are
   marked by text.
4. Documents are counted by part and set of failures, at most 32 sets a part; all orders are derived from these counts.

Nulls and edges: a null text is an empty one; a null id is never larger than another, so its row doesn't fail E,
and no row fails E by it; repeated rows of one id don't make each other fail; a null part is the empty string;
an id has a label if any of its label rows has it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringe.session import spread

from .bitmap import Bitmap
from .scratch import discard, materialize

FILTERS = "ABCDE"
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#$%&*|"
#: Where the blocks of a text start, in code points: up to the longest string that Spark can hold.
STARTS = tuple(0 if i == 0 else 256 * 16 ** (i - 1) for i in range(7))
HOT_PARTS = 1_000


def text_failures(data: bytes, code_points: int) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails; ``bytes.split`` splits at ASCII white space."""
    words = data.split()
    failed = BIT["A"] * (len(words) < MIN_WORDS)
    failed |= BIT["B"] * (100 * len(set(words)) < DISTINCT_PERCENT * len(words))
    failed |= BIT["C"] * (100 * (len(data) - len(data.translate(None, CAPITALS))) > CAPITAL_PERCENT * code_points)
    return failed | BIT["D"] * (len(data.translate(None, MARKS)) < len(data))


def block_hash(text: Column, k: int) -> Column:
    """Hash of the ``k``-th block of a text that reaches it."""
    end = STARTS[k + 1] if k + 1 < len(STARTS) else 2**31 - 1
    return F.xxhash64(F.substring(text, STARTS[k] + 1, end - STARTS[k]))


def _refined(own: Column, length: Column, block: Column, k: int) -> Column:
    """A row's class after its ``k``-th block; that of a text which ended before stays."""
    return F.when(length > STARTS[k], F.xxhash64(own, block)).otherwise(own)


def _last_class(length: Column, blocks: list[Column]) -> Column:
    return reduce(lambda own, kb: _refined(own, length, kb[1], kb[0]), enumerate(blocks), length.cast("long"))


def _met(rows: DataFrame, classes: DataFrame, total: int, how: str) -> DataFrame:
    """``rows`` joined with ``classes`` (cls, rows_in, ...) on their class, the hot ones by broadcast."""
    hot = F.col("rows_in") * HOT_PARTS > total
    by_broadcast = rows.join(F.broadcast(classes.where(hot)), "cls")
    rest = rows.join(F.broadcast(classes.where(hot).select("cls")), "cls", "left_anti")
    return by_broadcast.unionByName(rest.join(classes.where(~hot), "cls", how), allowMissingColumns=True)


def repeated_classes(facts: DataFrame) -> DataFrame:
    """Rows ``cls``: the classes of more than one row, by length and then block by block. ``facts`` has total length and blocks."""
    total, longest = facts.agg(F.count("*"), F.coalesce(F.max("length"), F.lit(0))).first()
    rows = facts.select("length", "blocks", F.col("length").cast("long").alias("cls"))
    written: list[DataFrame] = []
    for k in range(-1, sum(start < longest for start in STARTS)):
        if k >= 0:
            rows = rows.withColumn("cls", _refined(F.col("cls"), F.col("length"), F.col("blocks")[k], k))
        counts = materialize(rows.groupBy("cls").agg(F.count("*").alias("rows_in")).where("rows_in > 1"), "classes")
        rows = materialize(_met(rows, counts, total, "inner").drop("rows_in"), "refined")
        discard(*written)
        written = [counts, rows]
    return rows.select("cls").distinct()


def _facts(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """A row for each document: id, part, failed (bits A to D), length, blocks, cls."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    measured = slim.withColumn("length", F.length("text")).withColumn("blocks", F.array(*[F.when(F.col("length") > STARTS[k], block_hash(F.col("text"), k)) for k in range(len(STARTS))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            failed = [text_failures(t.as_py(), n) for t, n in zip(texts, batch.column("length").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(failed, pa.int32()), batch.column("length"), batch.column("blocks")], ["id", "part", "failed", "length", "blocks"])

    kind = slim.schema["id"].dataType.simpleString()
    return spread(measured).mapInArrow(run, f"id {kind}, part string, failed int, length int, blocks array<bigint>")


def _texts_of(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows id, cls, text of the documents in ``classes`` (and, as a bitmap of fixed size tells them, some others)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    own = _last_class(F.length("text"), [block_hash(F.col("text"), k) for k in range(len(STARTS))])
    members = Bitmap(classes.select(F.xxhash64("cls").alias("hash")))
    keyed = slim.select("id", own.alias("cls"), F.xxhash64(own).alias("hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(members.holds(batch.column("hash").to_numpy()))).select(["id", "cls", "text"])

    return keyed.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, cls long, text string")


def document_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows ``<id_col>, part, failed`` for every document; ``failed`` has a bit for each filter, A the lowest."""
    facts = materialize(_facts(docs, id_col, text_col, part_col), "facts")
    total = facts.count()
    classes = materialize(repeated_classes(facts), "repeated")
    texts = _texts_of(docs, classes, id_col, text_col)
    tops = texts.groupBy("cls", "text").agg(F.min("id").alias("smallest"), F.count("*").alias("rows_in"))
    # Texts aren't written: almost always each class has one, and the class stands for it.
    of_class = tops.groupBy("cls").agg(F.count("*").alias("texts"), F.min("smallest").alias("smallest"), F.sum("rows_in").alias("rows_in"))
    of_class = materialize(of_class.where("rows_in > 1"), "duplicates")
    marked = _met(facts.withColumn("cls", _last_class(F.col("length"), [F.col("blocks")[k] for k in range(len(STARTS))])), of_class, total, "left")
    fails = F.coalesce((F.col("texts") == 1) & (F.col("id") > F.col("smallest")), F.lit(False))
    out = marked.where(F.coalesce(F.col("texts") == 1, F.lit(True))).select(F.col("id").alias(id_col), "part", F.col("failed").bitwiseOR(F.when(fails, BIT["E"]).otherwise(0)).alias("failed"))
    shared = of_class.where("texts > 1").select("cls")
    if not shared.isEmpty():
        out = out.unionByName(_by_text(docs, shared, id_col, text_col, part_col))
    return out


def _by_text(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``document_failures`` of the documents in ``classes`` that hold different texts: smallest ids are joined by text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = _last_class(F.length(text), [block_hash(text, k) for k in range(len(STARTS))])
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.length(text).alias("length"), own.alias("cls"))
    few = materialize(slim.join(classes, "cls", "left_semi"), "shared")
    smallest = few.groupBy("text").agg(F.min("id").alias("smallest")).select(F.col("text").alias("top"), "smallest")
    by_text = few.join(smallest, F.col("text") == F.col("top")).select("id", "part", "text", "length", F.coalesce(F.col("id") > F.col("smallest"), F.lit(False)).alias("later"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, later = (batch.column(c) for c in ("text", "length", "later"))
            bits = [text_failures(t.as_py(), n.as_py()) | BIT["E"] * e.as_py() for t, n, e in zip(texts.cast(pa.binary()), sizes, later, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(bits, pa.int32())], [id_col, "part", "failed"])

    return by_text.mapInArrow(run, f"`{id_col}` {few.schema['id'].dataType.simpleString()}, part string, failed int")


def _labelled(rows: DataFrame, labels: DataFrame, id_col: str, label_id: str) -> DataFrame:
    """``rows`` with whether the id has a label of good quality, and one of toxicity."""
    has = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("label_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    named = rows.where(F.col(id_col).isNotNull()).join(has.where("good + toxic > 0"), F.col(id_col) == F.col("label_id"), "left").drop("label_id")
    unnamed = rows.where(F.col(id_col).isNull()).withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    return named.unionByName(unnamed)


def audit_orders(failures: DataFrame) -> DataFrame:
    """What each filter does at each step of all 120 orders, for each part (``failures``: part, failed, good, toxic).

    ``shapley`` needs no walk through the orders: of the filters that a document fails each comes
    first in the same share of all orders.
    """
    sets = failures.groupBy("part", "failed").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    orders = F.explode(F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ","))
    steps = sets.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.expr("substring(filter_order, step, 1)")
    bit = reduce(lambda out, name: out.when(letter == name, BIT[name]), FILTERS[1:], F.when(letter == FILTERS[0], BIT[FILTERS[0]]))
    earlier = F.expr("substring(filter_order, 1, step - 1)")
    before = reduce(lambda a, b: a + b, [F.when(F.instr(earlier, name) > 0, BIT[name]).otherwise(0) for name in FILTERS])
    steps = steps.withColumns({"own": bit, "fails": F.col("failed").bitwiseAND(bit) != 0, "gone": F.col("failed").bitwiseAND(before) != 0})

    def total(value: Column | str, condition: Column) -> Column:
        return F.sum(F.when(condition, value if isinstance(value, Column) else F.col(value)).otherwise(0))

    fails, gone = F.col("fails"), F.col("gone")
    orders_of_set = F.expr(f"{len(list(permutations(FILTERS)))} div bit_count(failed)")
    return steps.groupBy("part", "filter_order", "step").agg(
        total("n", ~fails & ~gone).alias("kept"),
        total("n", fails & ~gone).alias("removed"),
        total("n", fails & gone).alias("redundant"),
        total("n", F.col("failed") == F.col("own")).alias("unique_fails"),
        total("good", fails & ~gone).alias("good_lost"),
        total("toxic", fails & ~gone).alias("toxic_lost"),
        total(F.col("n") * orders_of_set, fails).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", label_id: str = "doc_id") -> DataFrame:
    """Rows ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` (module docstring)."""
    failures = document_failures(docs, id_col, text_col, part_col)
    return audit_orders(_labelled(failures, labels, id_col, label_id))


def oracle() -> str:
    """The same over ``documents`` and ``labels`` as DuckDB SQL, walking through all orders."""
    orders = ", ".join(f"'{''.join(p)}'" for p in permutations(FILTERS))
    return rf"""
    with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
    w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from t),
    f as (select doc_id, part, len(words) < {MIN_WORDS} as a, 100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words) as b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(text) as c,
        regexp_matches(text, '[#$%&*|]') as d, coalesce(doc_id > min(doc_id) over (partition by text), false) as e from w),
    l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
    g as (select part, case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end || case when d then 'D' else '' end || case when e then 'E' else '' end as failed,
        coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from f left join l using (doc_id)),
    n as (select part, failed, count(*) as n, sum(good) as good, sum(toxic) as toxic from g group by all),
    o as (select *, unnest([{orders}]) as filter_order from n),
    s as (select *, unnest([1, 2, 3, 4, 5]) as step from o),
    u as (select *, substr(filter_order, step, 1) as own, contains(failed, substr(filter_order, step, 1)) as fails,
        list_has_any(string_split(failed, ''), string_split(substr(filter_order, 1, step - 1), '')) and step > 1 and failed <> '' as gone from s),
    r as (select part, filter_order, step, own, sum(case when not fails and not gone then n else 0 end)::bigint as kept,
        sum(case when fails and not gone then n else 0 end)::bigint as removed, sum(case when fails and gone then n else 0 end)::bigint as redundant,
        sum(case when failed = own then n else 0 end)::bigint as unique_fails, sum(case when fails and not gone then good else 0 end)::bigint as good_lost,
        sum(case when fails and not gone then toxic else 0 end)::bigint as toxic_lost from u group by all)
    select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        (sum(removed) over (partition by part, own))::bigint as shapley from r"""
