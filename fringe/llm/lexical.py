"""Ranked lexical search over inverted treaps.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. A document
scores, for each of an item's terms with repeats, the term's weight times a saturating impact of
its frequency and the document's length; all but the weights is whole-number arithmetic.

1. One pass over whole texts writes a row for each document: its length and, for each distinct term that
   some item asks for (a bitmap of fixed size tells), hash and frequency. Document count, total length and
   document frequencies are sums over that table, so they cover all documents.
2. Items' terms get their weights and form blocks of bounded size; the index is read once for each block.
3. Index rows are taken in shards, a bounded number of documents and postings at a time, sorted by id. In a
   shard each term's postings are a treap: a search tree by document, a heap by impact.
4. A query walks the treaps of all its terms at once. A state is a stretch of documents with, for each term,
   the treap node that covers it: the sum of the nodes' weighted impacts bounds every score in the
   stretch, which is left as soon as it can't reach the top k. Otherwise the document of the largest node
   is scored by a search down from the nodes, which also splits every treap at it into the two
   stretches beside it. States of many queries go through numpy together, the best first.
5. The shards' best k are merged in Spark, in two levels.

A frequent term, however many documents hold it, is thus spread over all shards; nothing is dropped,
and what is pruned can't be among the best k.

Nulls and edges: a null or empty text has no terms and doesn't count as a document; terms are compared as
64-bit hashes; rows of one item id with different texts are one item, repeated rows count once; a null
item id is an item; of equal scores the smaller document id is first, a null one last; repeated documents
are ranked each for itself; empty tables give no rows; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringe.session import spread

from .bitmap import Bitmap
from .near_dup import text_slices
from .scratch import materialize
from .textset import term_hashes

TOP = 20
#: Documents and postings of a shard.
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 1 << 21
#: Terms of the items of a block, unless one item has more.
BLOCK_TERMS = 1 << 18
#: Treap nodes that are looked at together.
CHUNK_NODES = 1 << 17
#: Tasks whose best are merged at the first level.
MERGED = 256
TERM_PATTERN = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def weight_of(documents: int, df):
    """Weight of a term that ``df`` of ``documents`` hold (a column or a number)."""
    return F.floor(1000 * F.log((2.0 * documents + 2) / (2.0 * df + 1))).cast("long")


def _term_counts(texts: Sequence[str | None], member=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, term and frequency of every distinct term (that ``member`` lets through), by text; and all terms of each text."""
    hashes, at = term_hashes(texts)
    sizes = np.diff(at)
    owner = np.repeat(np.arange(len(texts)), sizes)
    if member is not None and len(hashes):
        chosen = member(hashes)
        hashes, owner = hashes[chosen], owner[chosen]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))) if len(hashes) else np.zeros(0, np.int64)
    return owner[first], hashes[first], np.diff(np.append(first, len(hashes))), sizes


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Rows item, hash, repeats: the terms of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, hashes, counts, _ = _term_counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(owner)), pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))], ["item", "hash", "repeats"])

    slim = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct()
    rows = slim.mapInArrow(run, f"item {slim.schema['item'].dataType.simpleString()}, hash long, repeats long")
    return rows.groupBy("item", "hash").agg(F.sum("repeats").alias("repeats"))


def build_index(docs: DataFrame, asked: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id, n (terms of the document), terms (hashes), counts: one for each document with a term.

    With ``asked`` (a table with a column ``hash``) the lists hold those terms, and few others; without, all.
    """
    members = Bitmap(asked) if asked is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                owner, hashes, counts, sizes = _term_counts(batch.column("text").to_pylist(), members and members.holds)
                at = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(hashes.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(counts.astype(np.int32)))]
                rows = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes.astype(np.int64)), *lists], ["id", "n", "terms", "counts"])
                yield rows.filter(pa.array(sizes > 0))

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return spread(slim).mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, n long, terms array<bigint>, counts array<int>")


@dataclass
class Treaps:
    """One treap for each term over its postings, which lie together in the order of documents.

    ``left``, ``right`` and ``root`` are places of postings, -1 for none.
    """

    doc: np.ndarray
    impact: np.ndarray
    left: np.ndarray
    right: np.ndarray
    root: np.ndarray


def build_treaps(term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int) -> Treaps:
    """Treaps of postings sorted by term and document; of equal impacts the earlier document is the higher.

    A posting's parent is the lower of the two nearest higher ones beside it. These are found for all
    postings at once, by following the higher ones found so far until none is left to improve.
    """
    n = len(doc)
    starts = np.searchsorted(term, np.arange(terms + 1))
    place = np.arange(n)
    before, after = place - 1, place + 1
    filled = starts[:-1][starts[:-1] < starts[1:]]
    before[filled] = -1
    after[starts[1:][starts[:-1] < starts[1:]] - 1] = -1
    for near, lower in ((before, lambda a, b: a < b), (after, lambda a, b: a <= b)):
        open_ = place
        while len(open_):
            open_ = open_[near[open_] >= 0]
            open_ = open_[lower(impact[near[open_]], impact[open_])]
            near[open_] = near[near[open_]]
    left, right = np.full(n, -1), np.full(n, -1)
    root = np.full(terms, -1)
    high_before = np.where(before >= 0, impact[before], np.iinfo(np.int64).max) if n else impact
    high_after = np.where(after >= 0, impact[after], np.iinfo(np.int64).max) if n else impact
    top = (before < 0) & (after < 0)
    root[term[top]] = place[top]
    under_after = ~top & (after >= 0) & ((before < 0) | (high_after <= high_before))
    left[after[under_after]] = place[under_after]
    under_before = ~top & ~under_after
    right[before[under_before]] = place[under_before]
    return Treaps(doc, impact, left, right, root)


@dataclass
class Best:
    """The k best documents of each query so far, best first: scores (0 for none) and places in the shard."""

    score: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, queries: int, k: int) -> Best:
        return cls(np.zeros((queries, k), np.int64), np.full((queries, k), np.iinfo(np.int64).max))

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """Documents scored, each once for a query."""
        k = self.score.shape[1]
        own = score > self.score[query, -1]
        own |= (score == self.score[query, -1]) & (doc < self.doc[query, -1])
        own &= score > 0
        query, doc, score = query[own], doc[own], score[own]
        if not len(query):
            return
        touched = np.unique(query)
        every = np.concatenate((np.repeat(touched, k), query))
        docs, scores = np.concatenate((self.doc[touched].ravel(), doc)), np.concatenate((self.score[touched].ravel(), score))
        order = np.lexsort((docs, -scores, every))
        starts = np.searchsorted(every[order], touched)
        first = order[(starts[:, None] + np.arange(k)).ravel()]
        self.score[touched], self.doc[touched] = scores[first].reshape(-1, k), docs[first].reshape(-1, k)


@dataclass
class Queries:
    """Queries of a block: for each of their terms the query's number, the term's number in ``vocabulary`` and weight times repeats, sorted by query."""

    query: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    vocabulary: np.ndarray
    count: int


def _within(treaps: Treaps, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Below each node the highest one whose document is in [low, high), -1 if there is none."""
    node = node.copy()
    at = np.flatnonzero(node >= 0)
    while len(at):
        doc = treaps.doc[node[at]]
        under, over = doc < low[at], doc >= high[at]
        node[at] = np.where(under, treaps.right[node[at]], np.where(over, treaps.left[node[at]], node[at]))
        at = at[(under | over) & (node[at] >= 0)]
    return node


def _split(treaps: Treaps, node: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each node's treap over [low, high) split at a document: the roots before and after it, and the document's own impact, 0 where it isn't there."""
    before, after, impact = np.full(len(node), -1), np.full(len(node), -1), np.zeros(len(node), np.int64)
    at, here = np.arange(len(node)), node
    while len(at):
        there, sought = treaps.doc[here], doc[at]
        less, same = there < sought, there == sought
        for side, met, child in ((before, less & (there >= low[at]), treaps.left), (after, ~less & ~same & (there < high[at]), treaps.right)):
            free = side[at] < 0
            side[at[met & free]] = here[met & free]
            side[at[same & free]] = child[here[same & free]]
        impact[at[same]] = treaps.impact[here[same]]
        here = np.where(less, treaps.right[here], treaps.left[here])
        onward = ~same & (here >= 0)
        at, here = at[onward], here[onward]
    return _within(treaps, before, low, doc), _within(treaps, after, doc + 1, high), impact


def search(treaps: Treaps, queries: Queries, k: int, floor: np.ndarray) -> tuple[Best, int]:
    """The best k of a shard for every query, and how many documents were scored; documents below ``floor`` may be left out."""
    best = Best.of(queries.count, k)
    node = treaps.root[queries.term]
    live = node >= 0
    starts = np.flatnonzero(np.diff(queries.query[live], prepend=-1))
    # A state: query and stretch of documents; its nodes lie together, with their weights.
    docs = int(treaps.doc.max(initial=-1)) + 1
    stack = [(queries.query[live][starts], np.zeros(len(starts), np.int64), np.full(len(starts), docs), starts, node[live], queries.weight[live])]
    scored = 0
    while stack:
        query, low, high, starts, node, weight = stack.pop()
        if not len(query):
            continue
        value = weight * treaps.impact[node]
        bound = np.add.reduceat(value, starts)
        kth = best.score[query, -1]
        keep = (bound > kth) | ((bound == kth) & (low < best.doc[query, -1]))
        keep &= (bound >= floor[query]) & (bound > 0)
        sizes = np.diff(np.append(starts, len(node)))
        if not keep.all():
            of = np.repeat(keep, sizes)
            query, low, high, sizes, bound = query[keep], low[keep], high[keep], sizes[keep], bound[keep]
            node, weight, value = node[of], weight[of], value[of]
            starts = np.cumsum(sizes) - sizes
            if not len(query):
                continue
        if len(node) > CHUNK_NODES and len(query) > 1:  # the promising half first
            order = np.argsort(bound - np.maximum(best.score[query, -1], floor[query]), kind="stable")
            for half in (order[: len(order) // 2], order[len(order) // 2 :]):
                of = np.repeat(starts[half], sizes[half]) + np.arange(sizes[half].sum()) - np.repeat(np.cumsum(sizes[half]) - sizes[half], sizes[half])
                stack.append((query[half], low[half], high[half], np.cumsum(sizes[half]) - sizes[half], node[of], weight[of]))
            continue
        owner = np.repeat(np.arange(len(query)), sizes)
        highest = np.flatnonzero(value == np.maximum.reduceat(value, starts)[owner])
        highest = highest[np.diff(owner[highest], prepend=-1) > 0]
        doc = treaps.doc[node[highest]]
        before, after, impact = _split(treaps, node, doc[owner], low[owner], high[owner])
        best.add(query, doc, np.add.reduceat(weight * impact, starts))
        scored += len(query)
        sides = []
        for side, from_, to in ((after, doc + 1, high), (before, low, doc)):
            some = side >= 0
            its = owner[some]
            first = np.flatnonzero(np.diff(its, prepend=-1))
            shift = len(sides[0][4]) if sides else 0
            sides.append((query[its[first]], from_[its[first]], to[its[first]], first + shift, side[some], weight[some]))
        stack.append(tuple(map(np.concatenate, zip(*sides, strict=True))))
    return best, scored


def _impacts(counts: np.ndarray, sizes: np.ndarray, documents: int, length: int) -> np.ndarray:
    """A term's impact by its frequency and the document's length, in whole numbers."""
    m = 100 - 25 + (25 * sizes * documents) // length
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def search_index(index: DataFrame, queries: Queries, numbers: tuple[int, int], k: int) -> DataFrame:
    """Rows query (its number), id, score: the best ``k`` of each shard of the index."""
    documents, length = numbers
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def shard(rows: pa.Table, floor: np.ndarray) -> pa.RecordBatch | None:
        block = sent.value
        rows = rows.sort_by([("id", "ascending")]).combine_chunks()  # nulls last
        terms, counts = rows.column("terms").chunk(0), rows.column("counts").chunk(0)
        doc = np.repeat(np.arange(rows.num_rows), pc.list_value_length(terms).to_numpy())
        hashes, tf = terms.flatten().to_numpy().view(np.uint64), counts.flatten().to_numpy().astype(np.int64)
        term = np.searchsorted(block.vocabulary, hashes)
        term[term == len(block.vocabulary)] = 0
        met = block.vocabulary[term] == hashes
        doc, term, tf = doc[met], term[met], tf[met]
        order = np.argsort(term, kind="stable")
        doc, term, tf = doc[order], term[order], tf[order]
        impact = _impacts(tf, rows.column("n").to_numpy()[doc], documents, length)
        best, _ = search(build_treaps(term, doc, impact, len(block.vocabulary)), block, k, floor)
        np.maximum(floor, best.score[:, -1], out=floor)
        found = best.score > 0
        query = np.repeat(np.arange(block.count), found.sum(1))
        ids = rows.column("id").chunk(0).take(pa.array(best.doc[found]))
        return pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), ids, pa.array(best.score[found])], ["query", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.zeros(sent.value.count, np.int64)
        held: list[pa.RecordBatch] = []
        docs = postings = 0
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + SHARD_POSTINGS - postings, "right")))
                stop = min(stop, start + max(1, SHARD_DOCS - docs))
                held.append(batch.slice(start, stop - start))
                docs, postings, start = docs + stop - start, postings + int(ends[stop - 1] - done), stop
                if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS or start < batch.num_rows:
                    yield shard(pa.Table.from_batches(held), floor)
                    held, docs, postings = [], 0, 0
        if held:
            yield shard(pa.Table.from_batches(held), floor)

    return index.mapInArrow(run, f"query int, id {index.schema['id'].dataType.simpleString()}, score long")


def _in_blocks(terms: DataFrame, block_terms: int) -> tuple[DataFrame, int]:
    """``terms`` (item, ...) with a block number, and how many: no block has over ``block_terms`` rows, unless of a single item."""
    blocks = max(1, -(-terms.count() // block_terms))
    while True:
        numbered = terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
        sizes = numbered.groupBy("block").agg(F.count("*").alias("rows"), F.min(F.xxhash64("item")).alias("low"), F.max(F.xxhash64("item")).alias("high"))
        if sizes.where((F.col("rows") > block_terms) & (F.col("low") < F.col("high"))).isEmpty():
            return numbered, blocks
        blocks = 2 * blocks + 1


def _best(rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    by_rank = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)


def rank_documents(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = TOP, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """Rows ``<item_col>, rank, <id_col>, score``: each item's ``k`` best documents with a score above 0 (module docstring)."""
    asked = materialize(item_terms(items, item_col, item_text_col), "asked")
    index = materialize(build_index(docs, asked, id_col, text_col), "index")
    documents, length = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = index.select(F.explode("terms").alias("hash")).groupBy("hash").agg(F.count("*").alias("df"))
    weighted = asked.join(df, "hash").select("item", "hash", (weight_of(documents, F.col("df")) * F.col("repeats")).alias("weight"))
    terms, blocks = _in_blocks(materialize(weighted, "weighted"), block_terms)
    terms = materialize(terms, "terms")
    kind = index.schema["id"].dataType.simpleString()
    found = [docs.sparkSession.createDataFrame([], f"item {terms.schema['item'].dataType.simpleString()}, part int, id {kind}, score long")]
    for number in range(blocks):
        block = terms.where(F.col("block") == number).toArrow().combine_chunks()
        if not block.num_rows:
            continue
        named = block["item"].chunk(0).dictionary_encode(null_encoding="encode")
        query, items_of = named.indices.to_numpy(), named.dictionary.to_pylist()
        vocabulary, term = np.unique(block["hash"].to_numpy().view(np.uint64), return_inverse=True)
        order = np.argsort(query, kind="stable")
        queries = Queries(query[order], term[order], block["weight"].to_numpy()[order], vocabulary, len(items_of))
        rows = search_index(index, queries, (documents, length), k).withColumn("part", F.floor(F.spark_partition_id() / MERGED).cast("int"))
        names = docs.sparkSession.createDataFrame(list(enumerate(items_of)), f"own int, item {terms.schema['item'].dataType.simpleString()}")
        found.append(rows.join(F.broadcast(names), F.col("query") == F.col("own")).select("item", "part", "id", "score"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    rows = _best(_best(rows, ["item", "part"], k).drop("rank"), ["item"], k)
    return rows.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def oracle(k: int = TOP) -> str:
    """The same over ``documents`` and ``benchmark`` as DuckDB SQL: every document that shares a term is scored."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pattern = TERM_PATTERN.replace("\\\\", "\\")
    return rf"""
    with d as (select row_number() over () as r, doc_id, regexp_extract_all({lower.format("coalesce(text, '')")}, '{pattern}') as terms from documents),
    s as (select r, doc_id, len(terms)::bigint as n from d where len(terms) > 0),
    c as (select count(*)::bigint as documents, sum(n)::bigint as length from s),
    p as (select r, unnest(terms) as term from d),
    t as (select r, term, count(*)::bigint as tf from p group by all),
    w as (select term, floor(1000 * ln((2.0::double * documents + 2) / (2.0::double * df + 1)))::bigint as w from (select term, count(*)::bigint as df from t group by term), c),
    i as (select distinct item_id, text from benchmark),
    j as (select item_id, unnest(regexp_extract_all({lower.format("coalesce(text, '')")}, '{pattern}')) as term from i),
    q as (select item_id, term, count(*)::bigint as repeats from j group by all),
    m as (select s.r, s.doc_id, 100 - 25 + ((25 * s.n * c.documents) // c.length) as m from s, c),
    e as (select q.item_id, m.doc_id, m.r, sum(q.repeats * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * m.m)))::bigint as score
        from q join w using (term) join t using (term) join m using (r) group by all),
    o as (select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank, doc_id, score from e where score > 0)
    select item_id, rank::int as rank, doc_id, score from o where rank <= {k}"""
