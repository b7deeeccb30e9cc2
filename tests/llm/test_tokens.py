import zlib

import numpy as np
import pytest

from fringe.llm import tokens
from fringe.llm.queries import tokenizer_path

TEXTS = ["", None, "Hello, hello. World's end. it's I'LL don't", "a\x1cb é́ É. á B́ H̱ x", "<|endoftext|> x<|ENDOFTEXT|>y", "K ΣΣ 漢字 🙂🙂 12 3.5 .. a., b", "a\0b \0 c", "word. " * 40_000, "\n\t "]


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokenizer_path(), remembered=50)


def test_encoder_equals_library(encoder):
    flat, sizes = encoder(TEXTS)
    want = encoder.plain([t or "" for t in TEXTS])
    assert sizes.tolist() == [len(x) for x in want]
    assert flat.tolist() == [i for x in want for i in x]
    flat, sizes = encoder([])
    assert len(flat) == len(sizes) == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_tokenizer_gives_the_librarys_ids(name):
    """A tokenizer whose words depend on case or on white space is not taken apart into words."""
    encode = tokens.Encoder(tokenizer_path(name))
    texts = [*TEXTS[:7], "Apple apple  Hello World. It's", "APPLE\n\napple"]
    flat, sizes = encode(texts)
    want = [encode.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]
    assert encode.by_words == (name == "word_bpe_49k.json")


def test_words_of_one_hash_are_told_apart(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "span_hashes", lambda data, starts: np.full(len(starts), 5, np.uint64))
    fresh = tokens.Encoder(tokenizer_path())
    for texts in (["one"], ["two"], ["one two one"], ["two"]):
        flat, _ = fresh(texts)
        assert flat.tolist() == [i for x in encoder.plain(texts) for i in x]


def test_round_trip_through_files(spark, encoder):
    rows = [(i * 7 % 50, TEXTS[i % len(TEXTS)]) for i in range(40)] + [(None, "null id"), (7, "same id"), (7, "same id")]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, start int")
    path = tokens.tokenized(df, tokenizer_path())
    back = tokens.read_tokens(spark, path).orderBy("start").collect()
    assert sorted(r.doc_id for r in back if r.doc_id is not None) == [r.doc_id for r in back if r.doc_id is not None]
    assert np.cumsum([0] + [r.n_tokens for r in back])[:-1].tolist() == [r.start for r in back]
    want = sorted(([] if i is None else [i], [*ids, tokens.END_ID]) for (i, _), ids in zip(rows, encoder.plain([t or "" for _, t in rows]), strict=True))
    assert sorted(([] if r.doc_id is None else [r.doc_id], list(r.token_ids)) for r in back) == want
    digests = {r.start: r.ids_crc32 for r in tokens.token_digests(spark, path).collect()}
    assert digests == {r.start: zlib.crc32(np.array(r.token_ids, "<u4").tobytes()) for r in back}


def test_empty_table(spark):
    path = tokens.tokenized(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path())
    assert tokens.read_tokens(spark, path).count() == 0


def test_token_ids_are_not_shuffled_by_part(spark):
    """A part's place is sent to the tasks that read it: the ids of a part don't meet in one task, whatever the threshold for broadcasts."""
    path = tokens.tokenized(spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string"), tokenizer_path())
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        for read in (tokens.read_tokens, tokens.token_digests):
            plan = read(spark, path)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set(key, before)
