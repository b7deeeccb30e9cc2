import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from fringe.llm import lexical

SCHEMA = "doc_id long, text string, id int, n int, terms int"


def documents():
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 3) for _ in range(n))
    out = [(i, text(rng.randrange(1, 60)), 0, 0, 0) for i in range(400)]
    out += [(1000 + i, "Common words_of a copy, É9é", 0, 0, 0) for i in range(150)]
    out += [(7, "repeated id common", 0, 0, 0), (7, "repeated id common", 0, 0, 0), (None, "common words a b c", 0, 0, 0), (2001, None, 0, 0, 0), (2002, "", 0, 0, 0), (2003, "?! --", 0, 0, 0)]
    return [*out, (2004, "common " * 100_000 + "rare", 0, 0, 0), (2005, "ÀB c d", 0, 0, 0)]


def items():
    rng = random.Random(12)
    out = [(i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 15)))) for i in range(30)]
    return [*out, (50, "COMMON words of"), (51, "common common rare"), (52, "nothing here matches qqq"), (53, None), (54, ""), (55, "a b"), (55, "a b"), (56, "a b"), (56, "b c"), (None, "é9é copy"), (57, "a-b_C"), (58, "àb")]


def expected(docs, asked):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "id", "n", "terms"]).astype({"doc_id": "Int64"}))
    con.register("benchmark", pd.DataFrame(asked, columns=["item_id", "text"]).astype({"item_id": "Int64"}))
    return sorted(map(repr, con.sql(lexical.oracle()).fetchall()))


@pytest.mark.parametrize("small", [False, True], ids=["production", "small shards and blocks"])
def test_equals_scoring_every_document(spark, monkeypatch, small):
    options = {}
    if small:
        for name in ("SHARD_DOCS", "SHARD_POSTINGS", "CHUNK_NODES"):
            monkeypatch.setattr(lexical, name, 40)
        options = {"block_terms": 20}
    df = spark.createDataFrame(documents(), SCHEMA).repartition(3)
    got = lexical.rank_documents(df, spark.createDataFrame(items(), "item_id long, text string"), **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(repr, map(tuple, got.collect()))) == expected(documents(), items())


def test_empty_tables(spark):
    docs, asked = spark.createDataFrame(documents()[:5], SCHEMA), spark.createDataFrame(items(), "item_id long, text string")
    assert lexical.rank_documents(docs.limit(0), asked).count() == 0
    assert lexical.rank_documents(docs, asked.limit(0)).count() == 0


def test_treaps_are_trees_by_document_and_heaps_by_impact():
    rng = np.random.default_rng(1)
    for _ in range(30):
        term = np.sort(rng.integers(0, 5, 200))
        doc = np.concatenate([np.sort(rng.choice(500, n, replace=False)) for n in np.bincount(term, minlength=5)])
        impact = rng.integers(1, 12, 200)
        t = lexical.build_treaps(term, doc, impact, 6)

        def walk(node, low, high, most, t=t):
            if node < 0:
                return 0
            assert low <= t.doc[node] < high and t.impact[node] <= most
            return 1 + walk(t.left[node], low, t.doc[node], t.impact[node]) + walk(t.right[node], t.doc[node] + 1, high, t.impact[node])

        assert [walk(r, 0, 500, 99) for r in t.root] == np.bincount(term, minlength=6).tolist()


def test_bounds_leave_documents_out():
    """Stretches that can't reach the top are left: few of the documents are scored."""
    n = 20_000
    doc = np.arange(n)
    impact = np.where(doc % 997 == 0, 1_000, 1 + doc % 7)
    t = lexical.build_treaps(np.zeros(n, np.int64), doc, impact, 1)
    one = lexical.Queries(np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.uint64), 1)
    best, scored = lexical.search(t, one, 20, np.zeros(1, np.int64))
    assert best.doc[0].tolist() == (997 * np.arange(20)).tolist() and scored < 200
