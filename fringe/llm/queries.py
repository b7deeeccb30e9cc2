"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat_format, decontam, exact_dup, filter_audit, lang_id, lexical, mixing, pii, tokens, url_filter, warc
from .near_dup import near_duplicates

#: The key of the pseudonyms; a deployment passes its own secret.
PII_KEY = "fringe-example-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_weighted_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents by source weight takes of each."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data under format-preserving pseudonyms."""
    return pii.pseudonymize(table(spark, sf_dir, "documents"), PII_KEY)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' token ids, from the written files."""
    path = tokens.tokenized(table(spark, sf_dir, "documents"), tokenizer_path())
    return tokens.token_digests(spark, path)


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that leak into documents."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the url of every page."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over 2-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC captures with a later revisit each, read and resolved."""
    return warc.resolved_pages(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, formatted and read back."""
    rows = chat_format.with_probe_conversation(table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.format_conversations(rows))


def op11_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of all for each benchmark item."""
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents."""
    return exact_dup.exact_duplicates(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents, in every order."""
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_weighted_fair_mixing,
        op2_hilbert_neighbours,
        op3_pii_feistel,
        op4_token_output,
        op5_template_decontamination,
        op6_url_filter,
        op7_minhash_near_dedup,
        op8_warc_revisits,
        op9_language_id,
        op10_chat_format,
        op11_treap_search,
        op12_heavy_hitter_dedup,
        op13_filter_audit,
    )
}

ORACLES: dict[str, str] = {
    "op1_weighted_fair_mixing": mixing.oracle(),
    "op6_url_filter": url_filter.oracle(),
    "op8_warc_revisits": warc.oracle(),
    "op10_chat_format": chat_format.oracle(),
    "op11_treap_search": lexical.oracle(),
    "op12_heavy_hitter_dedup": exact_dup.oracle(),
    "op13_filter_audit": filter_audit.oracle(),
}
