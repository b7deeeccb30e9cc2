"""Groups of tables as an edge table (group_id, member_id), which may nest and share members."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringe.session import checkpointed, fresh


def members(edges: DataFrame, group_id=None) -> DataFrame:
    rows = edges if group_id is None else edges.where(F.col("group_id") == group_id)
    return rows.select("group_id", "member_id").distinct()


def count_members(edges: DataFrame) -> DataFrame:
    return members(edges).groupBy("group_id").agg(F.count("*").alias("n_members"))


def count_groups(edges: DataFrame) -> DataFrame:
    """In how many groups each member is."""
    return members(edges).groupBy("member_id").agg(F.count("*").alias("n_groups"))


def add_member(edges: DataFrame, group_id, member_id) -> DataFrame:
    new = edges.sparkSession.createDataFrame([(group_id, member_id)], edges.select("group_id", "member_id").schema)
    return edges.select("group_id", "member_id").unionByName(new).distinct()


def remove_member(edges: DataFrame, group_id, member_id) -> DataFrame:
    return edges.where(~((F.col("group_id") == group_id) & (F.col("member_id") == member_id)))


def merge(edges: DataFrame, source, target) -> DataFrame:
    """The members of ``source`` moved to ``target``."""
    return edges.withColumn("group_id", F.when(F.col("group_id") == source, F.lit(target)).otherwise(F.col("group_id"))).distinct()


def copy_group(edges: DataFrame, source, target) -> DataFrame:
    own = edges.where(F.col("group_id") == source).withColumn("group_id", F.lit(target).cast(edges.schema["group_id"].dataType))
    return edges.unionByName(own).distinct()


def reachable(edges: DataFrame, checkpoint_every: int = 8) -> DataFrame:
    """``group_id, member_id, depth``: everything in a group or in groups within it, by its shortest path; cycles end where they close.

    A level is a join with the edges and an anti-join with what was found; the loop ends when a level finds nothing new,
    however deep that is. Every few levels what was found is written, so that the plan doesn't grow with the depth.
    """
    edges = checkpointed(members(edges))
    onward = edges.select(F.col("group_id").alias("member_id"), F.col("member_id").alias("next"))
    found = level = edges.withColumn("depth", F.lit(1))
    for depth in itertools.count(2):
        new = level.join(onward, "member_id").select("group_id", F.col("next").alias("member_id")).distinct()
        level = checkpointed(new.join(found, ["group_id", "member_id"], "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            return found
        found = found.unionByName(level)
        if depth % checkpoint_every == 0:
            found = checkpointed(found)


def compact(edges: DataFrame, top) -> DataFrame:
    """The edges with ``top`` holding directly all that its groups hold, and no groups."""
    flat = reachable(edges).where(F.col("group_id") == top)
    groups = edges.select(F.col("group_id").alias("member_id")).distinct()
    return edges.where(F.col("group_id") != top).unionByName(flat.join(groups, "member_id", "left_anti").select("group_id", "member_id"))


def remove_group(edges: DataFrame, group_id, recursive: bool = False) -> DataFrame:
    """Without a group; with ``recursive`` also without the groups within it."""
    gone = edges.sparkSession.createDataFrame([(group_id,)], edges.select("group_id").schema)
    if recursive:
        gone = gone.unionByName(reachable(edges).where(F.col("group_id") == group_id).select(F.col("member_id").alias("group_id"))).distinct()
    rest = edges.join(gone, "group_id", "left_anti")
    return rest.join(gone.withColumnRenamed("group_id", "member_id"), "member_id", "left_anti").select(*edges.columns)


def broken_links(edges: DataFrame, tables: DataFrame, id_col: str = "table_id") -> DataFrame:
    """Edges whose member isn't there."""
    return edges.join(tables.select(F.col(id_col).alias("member_id")).distinct(), "member_id", "left_anti")


def resolved(location: Column, group_location: Column) -> Column:
    """Where a member is: in the group's own file without a location, beside it with a relative one, ``.`` and ``..`` taken out."""
    absolute = location.rlike("^([A-Za-z][A-Za-z0-9+.-]*:)?/")
    beside = F.concat(F.regexp_replace(group_location, "[^/]*$", ""), location)
    path = F.when(F.coalesce(location, F.lit("")) == "", group_location).when(absolute, location).otherwise(beside)
    up = lambda kept: F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
    steps = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda kept, x: F.when(x == ".", kept).when(x == "..", up(kept)).otherwise(F.concat(kept, F.array(x))))
    return F.array_join(steps, "/")


def find_members(members_: DataFrame, tables: DataFrame, table_id: str = "table_id") -> DataFrame:
    """``members_`` with ``table_id`` and ``matched_by``, the table that each refers to: ``name``, ``position`` or null.

    A member (group_location, member_location, type, name, version, position, and columns of its own) refers to a
    table (table_id, location, type, name, version, position) in the file of its resolved location: by type and name, in any
    case, and version (1 where there is none), of several the one at its position, else the first; what isn't found by name
    is by position, of its type if it has one. Each table is matched once in a group, by its first member row in the order of
    position, of the others none. Both steps are equi-joins, so a file of many tables and many members makes no pairs of all.
    """
    m_id, place, kind, name, version, at, found, first = fresh([*members_.columns, *tables.columns, "matched_by"], "member_row", "m_place", "m_kind", "m_name", "m_version", "m_at", "found", "first")
    text = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    asked = members_.withColumns({m_id: F.monotonically_increasing_id(), place: resolved(F.col("member_location"), F.col("group_location")), kind: text("type"), name: text("name"), version: F.coalesce("version", F.lit(1)), at: F.col("position")})
    asked = checkpointed(asked)  # row numbers must not be drawn again
    there = tables.select(F.col(table_id).alias(found), resolved(F.col("location"), F.col("location")).alias(place), text("type").alias(kind), text("name").alias(name), F.coalesce("version", F.lit(1)).alias(version), F.col("position").alias(at))
    nearest = lambda: F.min_by(found, F.struct((F.coalesce(F.col("asked_at") != F.col(at), F.lit(True))).alias("elsewhere"), at, found)).alias(found)
    slim = asked.select(m_id, place, kind, name, version, F.col(at).alias("asked_at"))
    by_name = slim.where(F.col(name) != "").join(there, [place, kind, name, version]).groupBy(m_id).agg(nearest())
    rest = slim.join(by_name, m_id, "left_anti").withColumnRenamed(kind, "asked_kind")
    by_position = rest.join(there, (rest[place] == there[place]) & (F.col("asked_at") == there[at]) & ((F.col("asked_kind") == "") | (F.col("asked_kind") == there[kind])))
    by_position = by_position.groupBy(m_id).agg(F.min(found).alias(found))
    hits = by_name.withColumn("matched_by", F.lit("name")).unionByName(by_position.withColumn("matched_by", F.lit("position")))
    met = asked.join(hits, m_id, "left")
    chosen = met.where(F.col(found).isNotNull()).groupBy("group_location", found).agg(F.min(F.struct((F.col("matched_by") != "name").alias("later"), F.col(at), F.col(m_id))).getField(m_id).alias(first))
    chosen = chosen.select(F.col(first).alias(m_id), F.lit(True).alias(first))
    once = met.join(chosen, m_id, "left")
    keep = F.coalesce(F.col(first), F.lit(False))
    return once.select(*[F.col(c) for c in members_.columns], F.when(keep, F.col(found)).alias(table_id), F.when(keep, F.col("matched_by")).alias("matched_by"))
