import random

import corpus_pipeline
from fringe.llm import lang_id

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "the quick brown fox jumps over the lazy dog while seven wizards box in the rain near an old stone bridge"


def tables(spark, folder, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_in_turn(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = [(i, " ".join(word() for _ in range(40)), "aa", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, rows[0][1], "aa", "s0", 1), (101, rows[1][1] + " zzzz", "aa", "s1", 1), (102, f"{word()} {ITEM}", "aa", "s2", 1), (103, None, "aa", "s0", 1), (104, "12 34 !!", None, "s0", 1), (105, "", "aa", "s0", 1), rows[2]]
    folder = tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["language_id"](spark, docs, folder)
    assert kept.columns == docs.columns and sorted({r.doc_id for r in kept.collect()}) == sorted({r[0] for r in rows} - {103, 104, 105})
    one = steps["near_dedup"](spark, kept, folder)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == [*range(60), 102]
    clean = steps["decontamination"](spark, one, folder)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == list(range(60))
    mix = steps["mixing"](spark, clean, folder)
    assert mix.columns == docs.columns and {r.doc_id for r in mix.collect()} <= set(range(60))
    out = corpus_pipeline.run(spark, folder)
    assert out.count() == mix.count() and out.columns == ["doc_id", "start", "n_tokens", "token_ids"]


def test_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [])).count() == 0


def test_texts_in_no_language_are_rejected(spark, tmp_path):
    rng = random.Random(4)
    words = {"aa": "the and tion house with", "bb": "der und keit haus über", "cc": "él que ción casa año", "dd": "les eau été mais où"}
    text = lambda own, n: " ".join(rng.choice(own.split()) for _ in range(n))
    rows = [(i, text(words[lang], 40), lang, "s", 1) for i, lang in enumerate(sorted(words) * 60)]
    noise = " ".join("".join(rng.choice("bfgjkpvwxyz") for _ in range(5)) for _ in range(40))
    rows += [(900, text("кошка спит стуле девочка окна", 40), None, "s", 1), (901, noise, None, "s", 1), (902, text(" ".join(words.values()), 200), None, "s", 1), (903, text(words["bb"], 4000), None, "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, str(tmp_path)).collect()}
    assert not kept & {900, 901, 902} and 903 in kept
    assert len(kept & set(range(240))) >= 236


def test_null_ids_ties_long_texts_and_clashing_names(spark, tmp_path):
    """Columns that bear the stages' own names, null and repeated ids, ties, and a very long text."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(None if i % 3 == 0 else i // 2, text(40), "aa", "s", 1, i, i, i, i) for i in range(40)] + [(None, text(60_000), "aa", None, 1, 1, 1, 1, 1)]
    rows += [rows[0], rows[4]]
    schema = f"{DOCS}, take_id int, node int, leak_digest int, found int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (None, ""), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        if name != "token_output":
            assert out.columns == docs.columns
            docs = out
        if name == "near_dedup":
            assert out.count() == 41
    assert out.count() == docs.count() > 30


def test_language_stage_learns_from_every_labelled_row(spark, monkeypatch):
    """Rows beyond the sample of the first network, in letters that it never met: they are learned from, and partitions don't matter."""
    rng = random.Random(6)
    text = lambda own, n: " ".join(rng.choice(own.split()) for _ in range(n))
    rows = [(i, text("the and tion house with", 20) if i % 2 else text("der und keit haus mit", 20), "ab"[i % 2], "s", 1) for i in range(400)]
    rare = [(1000 + i, text("кошка спит стуле девочка окна", 20), "a", "s", 1) for i in range(60)]
    monkeypatch.setattr(lang_id, "DOCS_PER_LANGUAGE", 40)
    monkeypatch.setattr(lang_id, "SHARD_BYTES", 8_000)
    monkeypatch.setattr(lang_id.labelled_sample, "__defaults__", (*lang_id.labelled_sample.__defaults__[:-1], 40))
    monkeypatch.setattr(lang_id.fit, "__defaults__", (*lang_id.fit.__defaults__[:4], 40, *lang_id.fit.__defaults__[5:]))
    docs = spark.createDataFrame(rows + rare, DOCS)
    sampled = {int(r.id) for r in lang_id.labelled_sample(docs, docs_per_language=60).collect()}
    rare = [r for r in rare if r[0] not in sampled]
    docs = spark.createDataFrame(rows + rare, DOCS)
    net = lang_id.fit_whole(docs)
    assert net.learned == sum(len(r[1].encode()) for r in rows + rare) and net.seen["к".encode()[0]]
    again = lang_id.fit_whole(docs.repartition(7))
    assert all((getattr(net, n) == getattr(again, n)).all() for n in lang_id.WEIGHTS)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert len(kept & {r[0] for r in rare}) > 0.9 * len(rare) and len(kept & set(range(400))) > 390
