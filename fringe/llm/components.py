"""Connected components of an undirected link table, as a loop of joins and minimum aggregates until few links are left."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize


#: Links that one task joins without further rounds: a bound, so what a task holds doesn't grow with the table.
FEW_LINKS = 50_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _join_few(links: DataFrame) -> DataFrame:
    """``links`` (u, v) of few rows as stars (u, its root), by union and find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def find(x):
            while (up := above.get(x, x)) != x:
                above[x] = above.get(up, up)
                x = up
            return x

        kind = None
        for batch in batches:
            kind = batch.schema
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                low, high = sorted((find(u), find(v)))
                if low != high:
                    above[high] = low
        if kind is not None:
            nodes = list(above)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind.field("u").type), pa.array(map(find, nodes), kind.field("v").type)], ["u", "v"])

    return links.coalesce(1).mapInArrow(run, links.schema)


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Rows ``node, root``: every node that has a link, with the smallest node it can reach.

    Alternates the large-star and small-star steps, which keep components and shrink their depth to
    one in a logarithmic number of rounds. Each step is a partially aggregated minimum and an
    equi-join with it. The minima are written before they are joined, so that both sides of a join are
    plain shuffles, whose large keys (the centre of a star) AQE can split. Self links and null ends are
    ignored; an empty table gives an empty result. Up to ``FEW_LINKS`` links need no rounds, each of which
    has a dozen stages of as many tasks as shuffles have: one task joins them.
    """
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "links")
    now, before = _state(edges), None
    while now != before:
        if now[0] <= FEW_LINKS:
            used, edges = edges, materialize(_join_few(edges), "links")
            discard(used)
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        met = large.join(least, "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        used, edges = edges, materialize(small, "links")
        discard(used, low, large, least)
        before, now = now, _state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
