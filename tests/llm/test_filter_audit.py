import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fringe.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, part string, good int, cls long"


def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6)))
    texts = [" ".join(word() for _ in range(rng.choice([0, 3, 99, 100, 101, 150]))) for _ in range(40)]
    texts += [" ".join(rng.choice(["x", "y", "Zé"]) for _ in range(120)), "UPPER " * 110, "a & b", "tab\tone\x0btwo three", "é" * 300, "é" * 255 + "ö" + "é" * 44, "k" * 256, "k" * 257, "k" * 5000 + "x", "k" * 5000 + "y"]
    out = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""]), "p", 1, 1) for i in range(300)]
    out += [(1000 + i, "one hot text of the table", "en", "p", 1, 1) for i in range(200)]
    long = "word and more " * 40_000
    return [*out, (5, "repeated id", "en", "p", 1, 1), (5, "repeated id", "en", "p", 1, 1), (6, None, "en", "p", 1, 1), (7, "", None, "p", 1, 1), (None, "a & b", "de", "p", 1, 1), (None, None, None, "p", 1, 1), (8, long, "fr", "p", 1, 1), (9, long, "fr", "p", 1, 1)]


LABELS = [(i, i % 2, i % 3 == 0) for i in range(0, 400, 2)] + [(4, 1, 0), (4, 1, 1), (None, 1, 1), (1001, None, 1)]


def both(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    labels = spark.createDataFrame([(a, b if b is None else int(b), int(c)) for a, b, c in LABELS], "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows(), columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"}))
    con.register("labels", pd.DataFrame(LABELS, columns=["doc_id", "quality", "toxic"]).astype({"doc_id": "Int64", "quality": "Int64", "toxic": int}))
    return docs, labels, con


def agree(docs, labels, con):
    got = filter_audit.audit_filters(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(filter_audit.oracle()).fetchall())


def test_equals_sql(spark):
    agree(*both(spark))


@pytest.mark.parametrize("same", ["all", "first"])
def test_texts_that_share_a_class_are_told_apart(spark, monkeypatch, same):
    """With a block hash that hardly tells texts apart, whole texts still decide."""
    monkeypatch.setattr(filter_audit, "block_hash", lambda text, k: F.lit(1).cast("long") if same == "all" else F.xxhash64(F.substring(text, 1, 1)))
    agree(*both(spark))


def test_orders_account_for_every_document(spark):
    docs, labels, _ = both(spark)
    got = filter_audit.audit_filters(docs, labels).toPandas()
    size = docs.groupBy(F.coalesce("lang", F.lit("")).alias("part")).count().toPandas().set_index("part")["count"]
    assert len(got) == 600 * len(size)
    for part, own in got.groupby("part"):
        last = own[own.step == 5]
        removed = own.groupby("filter_order")["removed"].sum()
        assert last.kept.nunique() == 1 and (removed + last.kept.iloc[0] == size[part]).all()


def test_empty_tables(spark):
    docs, labels, _ = both(spark)
    assert filter_audit.audit_filters(docs.limit(0), labels).count() == 0
    assert filter_audit.audit_filters(docs.limit(3), labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
