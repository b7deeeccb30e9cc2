import random
from pathlib import Path

import numpy as np
import pytest

from fringe.llm import lang_id

WORDS = {"aa": ["the", "and", "tion", "house", "with"], "bb": ["der", "und", "keit", "haus", "über"], "cc": ["él", "que", "ción", "casa", "año"]}


def text(lang, rng, n=30):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_backpropagation_equals_differences():
    rng = np.random.default_rng(0)
    net = lang_id.new_network(["x", "y", "z"], 3, rng)
    for name in ("table", "recurrent", "inner", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64) + rng.normal(0, 0.1, getattr(net, name).shape))
    codes, mask = lang_id._lay_out([b"abc", b"ba", b"cabca"], 5)
    labels = np.array([0, 2, 1])
    grads, _ = lang_id._gradients(net, codes, mask, labels)
    for name in ("table", "recurrent", "inner", "out", "bias"):
        values, seen = getattr(net, name), 0
        for at in np.ndindex(values.shape):
            if name == "table" and at[1] not in (0, 97, 98, 99):
                continue
            old = values[at]
            values[at] = old + 1e-3
            up = lang_id._gradients(net, codes, mask, labels)[1]
            values[at] = old - 1e-3
            down = lang_id._gradients(net, codes, mask, labels)[1]
            values[at] = old
            assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3, (name, at)
            seen += 1
        assert seen


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(5)
    rows = [(i, text(lang, rng), lang, "s", 0.0) for i, lang in enumerate(["aa", "bb", "cc"] * 80)]
    rows += [(900, None, "aa", "s", 0.0), (901, "", "bb", "s", 0.0), (902, "123 ... !", None, "s", 0.0), (903, text("cc", rng, 20_000), None, "s", 0.0), (None, text("bb", rng), None, "s", 0.0), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    got = lang_id.identify(df).collect()
    by_id = {r.doc_id: r for r in got}
    held = [(r.lang_pred, rows[r.doc_id][2]) for r in got if r.held_out and r.doc_id < 900]
    assert len(held) > 20 and np.mean([a == b for a, b in held]) > 0.95
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (900, 901, 902))
    assert by_id[903].lang_pred == "cc" and by_id[None].lang_pred == "bb" and not by_id[None].held_out
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows)


def test_batches_do_not_change_the_result():
    rng = random.Random(1)
    windows = [text(lang, rng).encode()[:64] for lang in ["aa", "bb"] * 30]
    net = lang_id.train(windows, ["aa", "bb"] * 30, steps=60)
    texts = [text("aa", rng, n) for n in (1, 5, 200)] + [text("bb", rng, 90)]
    together = lang_id.document_probabilities(net, texts)
    alone = np.vstack([lang_id.document_probabilities(net, [t], task_windows=3) for t in texts])
    assert np.allclose(together, alone, atol=1e-5) and np.allclose(together.sum(1), 1, atol=1e-5)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert lang_id.identify(df).first().lang_pred == "und"
    assert lang_id.identify(df.limit(0)).count() == 0
    one = spark.createDataFrame([(i, "abc", "aa") for i in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in lang_id.identify(one).collect()} == {"aa"}


def test_sample_is_bounded_and_learns_from_null_ids(spark):
    rng = random.Random(2)
    rows = [(None, text(lang, rng), lang) for lang in ["aa", "bb"] * 100] + [(None, "repeated text of aa", "aa")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = lang_id.labelled_sample(df, docs_per_language=20)
    counts = dict(sample.groupBy("lang").count().collect())
    assert counts == {"aa": 20, "bb": 20}
    assert sorted(lang_id.labelled_sample(sample, id_col="id", docs_per_language=20).collect(), key=str) == sorted(sample.collect(), key=str)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").is_dir(), reason="needs the test tables")
def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    met = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(met) > 100 and np.mean([r.lang == r.lang_pred for r in met]) > 0.97
