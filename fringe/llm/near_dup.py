"""Near-duplicate documents from bottom-k sketches of one hash function.

1. Every text becomes the set of its word shingles; equal sets form a class, and from here on a class
   is one node. A node keeps the ``k`` smallest hashes of its set: its sketch.
2. Inverted lists of retained values give overlapping nodes. Two sets of Jaccard similarity 0.8 share
   at least ``overlap`` retained values but for a chance below one in a million, so a node is listed
   only under its ``k - overlap + 1`` rarest values: the two must meet in one of those. Values that
   many nodes retain come last in that order and open no lists, unless the nodes share most of their
   text.
3. A list of up to ``small_list`` nodes gives its pairs. A longer one gives a star around its most
   ordinary node (whose retained values are the most frequent); what that leaves unlinked goes to
   step 5.
4. The union sketch (the k smallest of both) estimates the similarity and drops pairs below
   ``overlap``; exact Jaccard on full sets decides the rest, and links become components.
5. Long lists that still hold several components are settled exactly: the full sets of their nodes
   are listed by their rarest shingles, as far as a partner of enough similarity could first meet
   them (a prefix and position filter), and only nodes of different components are paired.

Links are thus verified ones only, and no list is cut off. Components, not all pairs, are the result.

Nulls and edges: a null, empty or wordless text has the empty set, links with nothing and is kept; a
null id takes part and never becomes a component's id unless all ids of it are null; repeated rows
share a class; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringe.session import spread

from .bitmap import Bitmap
from .components import connected_components
from .rows import take
from .scratch import discard, materialize, short_batches
from .textset import shingle_sets

#: With their separators such slices stay below 1 MB, a power of two.
SLICE_BYTES = 950_000


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about ``SLICE_BYTES``, so that very long texts don't add up."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64), kind))


def _node(hashes: np.ndarray) -> bytes | None:
    return blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def sketch(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """A row for each document: id, text_key, n_shingles, node (null for the empty set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                sets = shingle_sets(batch.column("text").to_pylist(), width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        batch.column("text_key"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_node(s) for s in sets], pa.binary()),
                        _lists([s[:k] for s in sets], pa.int64()),
                    ],
                    ["id", "text_key", "n_shingles", "node", "sketch"],
                )

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return spread(slim).mapInArrow(run, "id long, text_key long, n_shingles long, node binary, sketch array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """The whole sets (node, hashes) of the ``wanted`` nodes, made again from their first document.

    Each text goes to one Python function, which leaves out those that aren't asked for: with a filter of its own
    before it, a stage would hold two Python workers for each core, and all of them stay in memory.
    """
    asked = Bitmap(wanted.select(F.xxhash64("id", "text_key").alias("hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole.filter(pa.array(asked.holds(whole.column("place").to_numpy()))), "text"):
                found = {_node(s): s for s in shingle_sets(batch.column("text").to_pylist(), width) if len(s)}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), _lists(list(found.values()), pa.int64())], ["node", "hashes"])

    texts = docs.select(F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text_col)).alias("place"), F.col(text_col).alias("text"))
    sets = texts.mapInArrow(run, "node binary, hashes array<bigint>").dropDuplicates(["node"])
    return sets.join(wanted.select("node"), "node", "left_semi")  # a bitmap may hold more than it was given


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with ``column`` of both ends, as a_x and b_x."""
    for end in ("a", "b"):
        pairs = pairs.join(table.select(F.col("node").alias(end), F.col(column).alias(f"{end}_x")), end)
    return pairs.select("a", "b", "a_x", "b_x")


def _compare(pairs: DataFrame, test) -> DataFrame:
    """The pairs for which ``test(x, y)`` holds on the sorted hash arrays a_x and b_x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a_x"), batch.column("b_x")
            a_at, b_at = a.offsets.to_numpy(), b.offsets.to_numpy()
            a_v, b_v = a.values.to_numpy().view(np.uint64), b.values.to_numpy().view(np.uint64)
            keep = [test(a_v[a_at[i] : a_at[i + 1]], b_v[b_at[i] : b_at[i + 1]]) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a binary, b binary")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    merged = np.concatenate((x, y))
    merged.sort(kind="stable")
    return int(np.count_nonzero(merged[1:] == merged[:-1]))


def _components(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    width: int,
    percent: int,
    k: int,
    overlap: int,
    small_list: int,
) -> DataFrame:
    """Rows id, text_key, n_shingles, root (null for the empty set), component (the smallest id) for every row of ``docs``."""

    def estimate(x: np.ndarray, y: np.ndarray) -> bool:
        merged = np.sort(np.concatenate((x, y)))
        twice = merged[1:][merged[1:] == merged[:-1]]
        union = len(merged) - len(twice)
        if union <= k:  # both sketches are whole sets
            return 100 * len(twice) >= percent * union
        last = np.unique(merged)[k - 1]
        return int(np.count_nonzero(twice <= last)) >= min(overlap, k)

    def exact(x: np.ndarray, y: np.ndarray) -> bool:
        shared = _shared(x, y)
        return 100 * shared >= percent * (len(x) + len(y) - shared)

    with short_batches(docs.sparkSession):
        rows = materialize(sketch(docs, id_col, text_col, width, k), "sketch")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("first_id"), F.min(F.struct("id", "text_key")).alias("at"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes.select("node", "first_id", "at.id", "at.text_key", "n", "sketch"), "nodes")

    # Inverted lists, rarest values first.
    values = nodes.select("node", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    # Counts by value are written before they are joined: both sides of the join are then plain shuffles,
    # whose large partitions (a value that very many nodes retain) Spark splits.
    df = materialize(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "df")
    shared = values.join(df, "value")
    by_node = Window.partitionBy("node").orderBy("df", "value")
    # Values of one node only rank first; they are counted, not carried.
    ranked = shared.withColumn("rank", F.row_number().over(by_node) + F.col("size") - F.count("*").over(Window.partitionBy("node")))
    listed = F.expr(f"size - least({overlap}, ({percent} * size + 99) div 100) + 1")
    ordinary = F.sum(F.log("df")).over(Window.partitionBy("node")) / F.col("size")
    lists = ranked.withColumn("ordinary", ordinary).where(F.col("rank") <= listed).select("value", "node", "n", "df", "ordinary")
    lists = materialize(lists, "lists")

    count = lists.groupBy("value").agg(F.count("*").alias("m"), F.max(F.struct("ordinary", "node")).getField("node").alias("centre"))
    count = materialize(count.where("m > 1"), "count")
    near_size = F.expr(f"100 * least(n, n2) >= {percent} * greatest(n, n2)")
    small = lists.join(count.where(F.col("m") <= small_list).select("value"), "value").select("value", "node", "n")
    small = materialize(small, "small")
    other = small.select("value", F.col("node").alias("node2"), F.col("n").alias("n2"))
    pairs = small.join(other, "value").where((F.col("node") < F.col("node2")) & near_size).select(F.col("node").alias("a"), F.col("node2").alias("b"))
    long_lists = materialize(lists.join(count.where(F.col("m") > small_list).select("value", "centre"), "value").select("value", "node", "n", "centre"), "long")
    star = long_lists.where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    pairs = pairs.unionByName(star).distinct()

    sketches = nodes.select("node", "sketch")
    likely = materialize(_compare(_both(pairs, sketches, "sketch"), estimate), "likely")
    residue_nodes = long_lists.select("node").distinct()
    ends = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).unionByName(residue_nodes).distinct()
    ends = materialize(ends.join(nodes.select("node", "id", "text_key"), "node"), "ends")
    with short_batches(docs.sparkSession):
        sets = materialize(full_sets(docs, ends, id_col, text_col, width), "sets")
        links = materialize(_compare(_both(likely, sets, "hashes"), exact), "linked")
    roots = materialize(connected_components(links), "roots")
    discard(df, lists, count, small, ends, likely, links)

    with short_batches(docs.sparkSession):
        roots = _settle(long_lists, sets, roots, percent, exact)

    # Written as the counts are: the members of one very large component are then split.
    rooted = nodes.select("node", "first_id").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first_id")
    low = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component")), "low")
    component = materialize(rooted.join(low, "root").select("node", "root", "component"), "component")
    discard(nodes, long_lists, sets, roots, low)
    return rows.select("id", "text_key", "n_shingles", "node").join(component, "node", "left").drop("node")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, k: int = 32, overlap: int = 13, small_list: int = 32
) -> DataFrame:
    """Rows ``<id_col>, n_shingles, component_id, kept`` for every row of ``docs`` (module docstring).

    ``overlap`` belongs to ``k`` and ``percent``: of the k smallest hashes of a union, each is shared
    with chance ``percent``/100 at least, and fewer than 13 of 32 has chance 1.9e-7 at 80 %.
    """
    out = _components(docs, id_col, text_col, width, percent, k, overlap, small_list)
    component_id = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component_id.alias("component_id"), F.col("id").eqNullSafe(component_id).alias("kept"))


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, k: int = 32, overlap: int = 13, small_list: int = 32
) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id; rows with the empty set all stay."""
    out = _components(docs, id_col, text_col, width, percent, k, overlap, small_list)
    same = out.groupBy("root", "id", "text_key").agg(F.count("*").alias("rows"))
    empty = same.where("root is null").select("id", "text_key", F.col("rows").alias("copies"), "rows")
    first = same.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_key", "rows")).alias("first"))
    return take(docs, first.select("first.id", "first.text_key", F.lit(1).cast("long").alias("copies"), "first.rows").unionByName(empty), id_col, text_col)


def _grow(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` with the components joined by ``links`` (a, b): only links between different roots are followed, as links of roots."""
    known = roots.select(F.col("node").alias("end"), F.col("root").alias("known"))
    for end in ("a", "b"):
        links = links.join(known, F.col(end) == F.col("end"), "left").withColumn(end, F.coalesce("known", end)).drop("end", "known")
    between = materialize(links.where("a <> b").distinct(), "between")
    if between.isEmpty():
        discard(between)
        return roots
    joined = materialize(connected_components(between), "joined")
    moved = roots.join(joined.select(F.col("node").alias("was"), F.col("root").alias("is")), F.col("root") == F.col("was"), "left")
    new = joined.join(roots.select("node"), "node", "left_anti")
    grown = materialize(moved.select("node", F.coalesce("is", "root").alias("root")).unionByName(new), "roots")
    discard(roots, between, joined)
    return grown


def _settle(long_lists: DataFrame, sets: DataFrame, roots: DataFrame, percent: int, exact) -> DataFrame:
    """``roots`` with all links between different components of the long lists, by exact prefix filtering of full sets.

    A first round links each node to the node of a list that has the fewest shingles of its own, which
    joins most of what belongs together; the second pairs what is still apart.
    """

    def rooted(table: DataFrame) -> DataFrame:
        return table.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    listed = rooted(long_lists.select("value", "node"))
    open_lists = listed.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("value")
    open_lists = materialize(open_lists, "open_lists")
    open_nodes = materialize(listed.join(open_lists, "value").select("node").distinct(), "open")
    if open_nodes.isEmpty():
        discard(open_lists, open_nodes)
        return roots
    full = open_nodes.join(sets, "node").select("node", F.size("hashes").alias("n"), F.explode("hashes").alias("value"))
    df = materialize(full.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "df")
    shared = full.join(df, "value")
    by_node = Window.partitionBy("node").orderBy("df", "value")
    own = F.col("n") - F.count("*").over(Window.partitionBy("node"))
    prefix = shared.withColumn("own", own).withColumn("place", F.row_number().over(by_node) - 1 + F.col("own"))
    prefix = materialize(prefix.where(f"place <= n - ({percent} * n + 99) div 100").select("value", "node", "n", "own", "place"), "prefix")

    hubs = prefix.groupBy("value").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "node")).getField("node").alias("hub"))
    hubs = materialize(hubs, "hubs")
    to_hub = prefix.join(hubs, "value").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    roots = _grow(roots, _compare(_both(to_hub, sets, "hashes"), exact))

    # Each pair of components has an end outside the list's most frequent component. Similar sets lie in
    # the same or in neighbouring bands of sizes, so a list that many nodes share is joined band by band.
    placed = rooted(prefix)
    sizes = placed.groupBy("value", "root").agg(F.count("*").alias("m"))
    main = sizes.groupBy("value").agg(F.max(F.struct("m", "root")).getField("root").alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
    main = materialize(main.select("value", "main"), "main")
    band = F.floor(F.log(F.col("n").cast("double")) / (1.001 * math.log(100 / percent))) if percent < 100 else F.col("n").cast("long")
    mixed = placed.join(main, "value").withColumn("band", band)
    few = mixed.where("root <> main").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    other = mixed.select("value", "band", F.col("node").alias("node2"), F.col("root").alias("root2"), F.col("n").alias("n2"), F.col("place").alias("place2"))
    needed = f"({percent} * (n + n2) + {99 + percent}) div {100 + percent}"
    fits = F.expr(f"root <> root2 and (root < root2 or root2 = main) and 1 + least(n - place - 1, n2 - place2 - 1) >= {needed}")
    pairs = few.join(other, ["value", "band"]).where(fits).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
    roots = _grow(roots, _compare(_both(pairs, sets, "hashes"), exact))
    discard(open_lists, open_nodes, df, prefix, hubs, main)
    return roots
