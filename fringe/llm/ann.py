"""Nearest neighbours by inner product, from shifted Hilbert orderings of projected vectors.

Vectors are projected to a few dimensions, once for each of several rotations, shifted and put in
the order of a Hilbert curve through that space; Spark range-partitions each ordering. A query takes
the rows within a window around its own place in every ordering and reranks them by the exact inner
product; what an earlier ordering's window holds is not taken again. The orderings' lists are merged.

How wide the window must be depends on the data: neighbours of vectors without structure are spread
over the whole curve. So it is measured, in rows. A bounded set of sample queries is answered by brute
force, and the window is the smallest in which the orderings together hold the wanted share of their
neighbours.

A bounded random sample of rows, the pivots, is ranked for every query beforehand. The score of its k-th best
pivot is a floor: what lies below it can't be among the k nearest, and a block passes on only what is above.

An ordering is cut into blocks of rows, and a query goes to the blocks that its window meets. A task
holds one block and a bounded number of queries; only a block that more queries reach is read by several.
Equal vectors are one entry with its smallest ids, so a vector that many rows share costs one row.
Vectors of each dimension are searched by themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, materialize

CURVES, DIMS, BITS = 3, 8, 7
BLOCK_ROWS = 4096
#: Vectors that scale the projections, queries that set the window, and the share of neighbours they must find.
FIT_ROWS, SAMPLE_QUERIES, RECALL = 4000, 128, 0.95
#: Rows that every query is ranked against first: this share of all, up to so many.
PIVOT_SHARE, PIVOTS = 1 / 16, 16_384
#: Distinct queries that one task holds beside a block, and how many of them are scored at a time.
QUERY_CHUNK, QUERY_STEP = 8192, 256
SALTS = 32


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer cells (n, d) with coordinates below 2**bits; d * bits <= 62."""
    x = [c.astype(np.int64) for c in cells.T]
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, largest cubes first
        for i in range(len(x)):
            inside = (x[i] & q) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(inside, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, len(x)):  # Gray code
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ turn) >> bit) & 1)
    return key


class Curves:
    """Rotations, shifts and scales of all orderings, fitted to a bounded sample."""

    def __init__(self, sample: np.ndarray, longest: float, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        wide = sample.shape[1] + 1
        self.longest, self.bits = longest, bits
        self.rotations = [np.linalg.qr(rng.normal(size=(wide, wide)))[0][:, : min(dims, wide)] for _ in range(curves)]
        self.shifts = [rng.uniform(0, 1, r.shape[1]) for r in self.rotations]
        self.low, self.span = [], []
        for r in self.rotations:
            p = self._lifted(sample) @ r
            low, high = np.quantile(p, [0.005, 0.995], axis=0)
            self.low.append(low)
            self.span.append(np.maximum(high - low, 1e-12))

    def _lifted(self, x: np.ndarray) -> np.ndarray:
        """With one more coordinate all rows are of the greatest length: there the largest inner product is the least distance."""
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        return np.hstack((x, rest[:, None]))

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        share = np.clip((self._lifted(x) @ self.rotations[curve] - self.low[curve]) / self.span[curve], 0, 1)
        cells = (share + self.shifts[curve]) / 2 * (1 << self.bits)
        return hilbert_keys(np.minimum(cells.astype(np.int64), (1 << self.bits) - 1), self.bits)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def _rank_block(q: np.ndarray, q_at: np.ndarray, rows: np.ndarray, at: np.ndarray, ids: pa.ListArray, curve: int, reach: int, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of each query's k best among the rows within ``reach`` of its place on the curve and on no earlier one, if not below its ``floor``.

    ``q_at`` and ``at`` are the places on all curves of the queries and of the block's rows.
    """
    own = np.argsort(at[:, curve], kind="stable")
    rows, at = rows[own], at[own]
    offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    asking = np.argsort(q_at[:, curve], kind="stable")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(asking), QUERY_STEP):
        some = asking[start : start + QUERY_STEP]
        first = np.searchsorted(at[:, curve], q_at[some[0], curve] - reach)
        last = np.searchsorted(at[:, curve], q_at[some[-1], curve] + reach, "right")
        if first == last:
            continue
        part, places = rows[first:last], at[first:last]
        rough = q[some] @ part.T
        out = np.abs(q_at[some, curve][:, None] - places[:, curve]) > reach
        for earlier in range(curve):
            out |= np.abs(q_at[some, earlier][:, None] - places[:, earlier]) <= reach
        rough[out] = -np.inf
        # The product of matrices chooses, with room for its rounding; scores are summed in one fixed order.
        limit = np.partition(rough, part.shape[0] - k, axis=1)[:, part.shape[0] - k] if part.shape[0] > k else np.full(len(some), -np.inf)
        if floor is not None:
            limit = np.maximum(limit, floor[some])
        room = np.where(np.isfinite(limit), limit - 1e-9 * (1 + np.abs(limit)), np.finfo(float).min)
        who, what = np.nonzero(rough >= room[:, None])
        exact = (part[what] * q[some[who]]).sum(1)
        entry = own[first + what]
        counts = offsets[entry + 1] - offsets[entry]
        members = flat[np.repeat(offsets[entry], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
        who, exact = np.repeat(some[who], counts), np.repeat(exact, counts)
        order = np.lexsort((members, -exact, who))
        who, members, exact = who[order], members[order], exact[order]
        begins = np.flatnonzero(np.diff(who, prepend=-1))
        keep = np.arange(len(who)) - np.repeat(begins, np.diff(np.append(begins, len(who)))) < k
        found.append((who[keep], members[keep], exact[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    curves: int = CURVES,
    block_rows: int = BLOCK_ROWS,
    recall: float = RECALL,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query row's k nearest other rows, nearest first, ties to the smaller id.

    ``is_query`` is a condition on the id column. Vectors that aren't ``usable`` and rows without an id take no part.
    Vectors of another dimension are no candidates, so each dimension (a few: every one costs its own jobs) is searched by itself.
    Repeated rows are one row; a query never returns its own id. Fewer than k candidates give all of them; an empty table gives no rows.
    Other columns are ignored.
    """
    vector = F.col(vector_col)
    if not rows.schema[vector_col].dataType.simpleString() == "array<float>":
        vector = vector.cast("array<double>")
    valid = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), is_query.alias("asks"))
    valid = valid.where(F.col("id").isNotNull() & usable(F.col("v")))
    out = None
    for d, n in sorted((r.d, r.n) for r in valid.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()):
        found = _nearest_of(valid.where(F.size("v") == d), d, k, curves, block_rows, recall)
        out = found if out is None else out.unionByName(found)
    return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _nearest_of(valid: DataFrame, dimension: int, k: int, curves: int, block_rows: int, recall: float) -> DataFrame:
    """``nearest`` for rows id, v, asks of one dimension."""
    kind = valid.schema["v"].dataType.simpleString()

    # Equal vectors: one entry with the k + 1 smallest ids, chosen in two steps.
    salted = Window.partitionBy("v", "salt").orderBy("id")
    every = Window.partitionBy("v").orderBy("id")
    few = valid.select("id", "v").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(every)).where(F.col("n") <= k + 1)
    entries = few.groupBy("v").agg(F.array_sort(F.array_distinct(F.collect_list("id"))).alias("ids"))
    entries = materialize(entries.withColumn("entry", F.monotonically_increasing_id()), "entries")
    asked = valid.where("asks").select("id", "v").join(entries.select("v", "entry"), "v").select(F.col("id").alias("query_id"), "entry").distinct()
    asked = materialize(asked, "asked")
    total = entries.count()

    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    longest = entries.agg(F.max(norm)).first()[0]
    share = F.pmod(F.xxhash64("entry"), F.lit(1 << 30)) / float(1 << 30)
    sample = np.array([r.v for r in entries.where(share < FIT_ROWS / total).select("v").limit(2 * FIT_ROWS).collect()] or [entries.first().v], float)
    fitted = Curves(sample, longest, curves)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            yield pa.RecordBatch.from_arrays([batch.column("entry"), *(pa.array(fitted.keys(x, c), pa.int64()) for c in range(curves))], ["entry", *(f"key_{c}" for c in range(curves))])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("entry"), pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(done + np.arange(batch.num_rows), pa.int64())], ["entry", "part", "nth"])
            done += batch.num_rows

    # Only keys are sorted. A place is a row's number in the whole ordering.
    keyed = materialize(entries.select("entry", "v").mapInArrow(keys, "entry long, " + ", ".join(f"key_{c} long" for c in range(curves))), "keys")
    placed = entries.select("entry", "v", "ids")
    used = [keyed]
    pivot = F.pmod(F.xxhash64("entry", F.lit("pivot")), F.lit(1 << 30)) / float(1 << 30) < min(PIVOT_SHARE, PIVOTS / total)
    for c in range(curves):
        ordered = keyed.select("entry", F.col(f"key_{c}").alias("key")).repartitionByRange("key", "entry").sortWithinPartitions("key", "entry").select("entry")
        ordered = materialize(ordered.mapInArrow(number, "entry long, part int, nth long"), "ordered")
        parts = ordered.groupBy("part").agg(F.count("*").alias("n"))  # one row for each written part
        before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = placed.join(ordered.join(parts.select("part", before.alias("before")), "part").select("entry", (F.col("before") + F.col("nth")).alias(f"at_{c}")), "entry")
        used.append(ordered)
    placed = materialize(placed.select("entry", "v", "ids", F.array(*[F.col(f"at_{c}") for c in range(curves)]).alias("at")), "placed")
    discard(*used)
    wanted = asked.select("entry").distinct()
    pivots = placed.where(pivot).select("v", "ids").orderBy("entry").limit(2 * PIVOTS).collect()
    pivot_rows, pivot_ids = np.array([r.v for r in pivots], float).reshape(len(pivots), dimension), pa.array([r.ids for r in pivots], pa.list_(pa.int64()))
    nowhere = np.zeros((len(pivots), 1), np.int64)

    def rank_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, ids, scores = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            if len(pivots) and batch.num_rows:
                who, ids, scores = _rank_block(_matrix(batch.column("v")), np.zeros((batch.num_rows, 1), np.int64), pivot_rows, nowhere, pivot_ids, 0, 0, k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("entry").to_numpy()[who]), pa.array(ids), pa.array(scores)], ["entry", "vec_id", "score"])

    first = materialize(placed.join(wanted, "entry").select("entry", "v").mapInArrow(rank_pivots, "entry long, vec_id long, score double"), "pivots")
    floors = first.groupBy("entry").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k + 1).select("entry", "floor")
    questions = placed.join(wanted, "entry").join(floors, "entry", "left").select("entry", "v", "at", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    questions = materialize(questions, "questions")
    # At least k + 1 entries to either side, so that a query has k candidates if there are as many.
    reach = max(k + 1, _window(placed, questions, k, recall, total))

    last_block = (total - 1) // block_rows
    blocks = F.sequence(F.greatest(F.expr(f"(place - {reach}) div {block_rows}"), F.lit(0)), F.least(F.expr(f"(place + {reach}) div {block_rows}"), F.lit(last_block)))
    spread = questions.select("entry", F.posexplode("at").alias("curve", "place")).select("entry", "curve", F.explode(blocks).alias("block"))
    # Of each block by how many tasks it is read: one, but for blocks that more queries reach than one task holds.
    chunks = materialize(spread.groupBy("curve", "block").agg(F.ceil(F.count("*") / QUERY_CHUNK).cast("int").alias("chunks")), "chunks")
    asking = spread.join(chunks, ["curve", "block"]).select("entry", "curve", "block", F.pmod(F.xxhash64("entry"), F.col("chunks")).cast("int").alias("chunk"))
    asking = asking.join(questions, "entry").select("curve", "block", "chunk", "entry", "v", "at", "floor")
    answers = placed.where(~pivot).select("v", "ids", "at", F.posexplode("at").alias("curve", "place")).withColumn("block", F.expr(f"place div {block_rows}"))
    answers = answers.join(chunks, ["curve", "block"]).select("curve", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "v", "ids", "at")

    def rank_block(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        who, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if left.num_rows and right.num_rows:
            places = [_matrix(side["at"]).astype(np.int64) for side in (left, right)]
            who, ids, scores = _rank_block(_matrix(left["v"]), places[0], _matrix(right["v"]), places[1], right["ids"].combine_chunks(), key[0].as_py(), reach, k + 1, left["floor"].to_numpy())
        asked_ = left["entry"].to_numpy() if left.num_rows else np.zeros(0, np.int64)
        return pa.table([pa.array(asked_[who]), pa.array(ids), pa.array(scores)], ["entry", "vec_id", "score"])

    by = ["curve", "block", "chunk"]
    ranked = asking.groupBy(*by).cogroup(answers.groupBy(*by)).applyInArrow(rank_block, "entry long, vec_id long, score double")
    best = Window.partitionBy("entry").orderBy(F.desc("score"), "vec_id")
    merged = ranked.unionByName(first).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = asked.join(merged, "entry").where("query_id <> vec_id").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def _window(placed: DataFrame, questions: DataFrame, k: int, recall: float, total: int) -> int:
    """Rows to either side that a query must take, by brute force on a bounded sample of queries."""
    picked = questions.orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE_QUERIES).select("entry", "v", "at").collect()
    if not picked:
        return 0
    names, vectors, at = np.array([r.entry for r in picked]), np.array([r.v for r in picked], float), np.array([r.at for r in picked])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            other = batch.column("entry").to_numpy()
            scores = vectors @ _matrix(batch.column("v")).T
            places = _matrix(batch.column("at")).astype(np.int64)
            m = min(k + 1, len(other))
            best = np.argpartition(-scores, m - 1, axis=1)[:, :m]
            distance = np.abs(places[best] - at[:, None, :]).min(2)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, m)), pa.array(other[best].ravel()), pa.array(np.take_along_axis(scores, best, 1).ravel()), pa.array(distance.ravel())], ["asking", "entry", "score", "distance"])

    found = placed.select("entry", "v", "at").mapInArrow(scan, "asking long, entry long, score double, distance long").where("asking <> entry")
    order = Window.partitionBy("asking").orderBy(F.desc("score"), "entry")
    distances = sorted(r.distance for r in found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("distance").collect())
    return distances[max(0, math.ceil(recall * len(distances)) - 1)] if distances else total
