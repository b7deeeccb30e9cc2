"""A corpus from documents: language, near duplicates, benchmark leaks, source mix, token files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringe.llm import decontam, lang_id, mixing, near_dup, tokens
from fringe.llm.queries import table, tokenizer_path
from fringe.llm.scratch import discard, materialize, short_batches
from fringe.session import fresh, spread


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no language: texts that are null or have no letter, or whose best language scores below what labelled texts of their length do.

    The network learns from every labelled row, and the floors are set on the scores of every labelled row. A verdict is one on a text,
    so repeated rows share it; ids play no part in it; an empty table stays empty.
    """
    net = lang_id.fit_whole(docs)
    if net is None:  # nothing to learn from: only texts without a letter can be told apart
        return docs.where(F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    text = F.col("text")
    found = spread(docs.select("text", "lang")).select(F.unhex(F.sha2(text, 256)).alias("digest"), lang_id.floor_class(text).alias("length"), F.col("lang").isNotNull().alias("labelled"), lang_id.language(net, text, unseen_even=True).alias("found"))
    with short_batches(spark):
        scored = materialize(found.select("digest", "length", "labelled", "found.*"), "scored")
    floors = lang_id.score_floors(net, scored.where("labelled"))
    floor = F.element_at(F.array(*map(F.lit, floors)), F.col("length") + 1)
    rejected = materialize(scored.where(F.col("digest").isNotNull() & ((F.col("lang") == lang_id.UNDETERMINED) | (F.col("score") < floor))).select("digest").distinct(), "rejected")
    discard(scored)
    own = F.unhex(F.sha2(text, 256))
    return docs.where(text.isNotNull()).join(rejected.select(F.col("digest").alias(name := fresh(docs.columns, "digest")[0])), own == F.col(name), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: five-word shingles, similarity 0.8.

    That of the smallest id stays, a null id last; texts without a word all stay.
    """
    return near_dup.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents into which a benchmark item leaks: by text, so ids may be null or repeat; a null text stays."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the source mix takes; a null source is one, texts without a word go."""
    return mixing.mixed(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and token_ids of every row, read from the written token files; a repeated or null id is a row for each time."""
    return tokens.read_tokens(spark, tokens.tokenized(docs, tokenizer_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_to_weights),
    ("token_output", write_token_files),
]

#: A trained network decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
