import random

import duckdb
import pandas as pd
import pytest

from fringe.llm import exact_dup

SCHEMA = "doc_id long, text string, row int, first int, size int, take_id int"


def rows():
    rng = random.Random(3)
    out = [(i, "the hot text", 0, 0, 0, 0) for i in range(500, 800)]
    out += [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(4))), 0, 0, 0, 0) for i in range(300)]
    out += [(900, "a  b\t\nc", 1, 1, 1, 1), (901, "a b c", 1, 1, 1, 1), (902, " a b c", 1, 1, 1, 1), (903, "a b c", 1, 1, 1, 1), (904, "A b c", 1, 1, 1, 1), (905, "a\x0bb\x0c\rc", 1, 1, 1, 1)]
    out += [(910, None, 2, 2, 2, 2), (911, "", 2, 2, 2, 2), (None, "the hot text", 3, 3, 3, 3), (None, "null only", 3, 3, 3, 3), (None, "null only", 4, 4, 4, 4)]
    out += [(920, "twice", 5, 5, 5, 5)] * 2 + [(921, "long " * 200_000, 6, 6, 6, 6), (922, "long " * 200_000, 7, 7, 7, 7)]
    return out


@pytest.mark.parametrize(("counters", "heavy_parts"), [(exact_dup.COUNTERS, exact_dup.HEAVY_PARTS), (16, 3), (16, 10**9)], ids=["production", "few heavy", "all candidates heavy"])
def test_equals_sql(spark, counters, heavy_parts):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(7)
    got = exact_dup.exact_duplicates(df, counters=counters, heavy_parts=heavy_parts)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows(), columns=["doc_id", "text", "row", "first", "size", "take_id"]).astype({"doc_id": "Int64"}))
    want = con.sql(exact_dup.oracle()).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_one_row_of_each_group_stays(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    kept = exact_dup.deduplicate(df, counters=16, heavy_parts=3)
    assert kept.columns == df.columns
    got = kept.collect()
    normal = lambda t: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert len(got) == len({normal(r[1]) for r in rows()}) == len({normal(r.text) for r in got})
    first = {}
    for r in rows():
        key = normal(r[1])
        first[key] = min(first.get(key, (True, 0)), (r[0] is None, r[0] or 0))
    assert all(first[normal(r.text)] == (r.doc_id is None, r.doc_id or 0) for r in got)


def test_no_python_and_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dup.exact_duplicates(none).count() == 0 and exact_dup.deduplicate(none).count() == 0
    plan = exact_dup.exact_duplicates(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_frequent_items_are_candidates(spark):
    df = spark.range(20_000).selectExpr("case when id % 3 = 0 then 7L when id % 50 = 1 then 9L else id end as item").repartition(9)
    assert {7, 9} <= {r.item for r in exact_dup.frequent(df, "item", 256, merged=2).collect()}


def test_more_partitions_than_summaries(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "31")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
        assert exact_dup.exact_duplicates(df).where("kept").count() == exact_dup.deduplicate(df).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
