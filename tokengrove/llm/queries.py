"""The operators over the test tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tokengrove.llm import (
    capture_index,
    embedding_dedup,
    language_id,
    mixing,
    perspectives,
    quality_rules,
    spelling_variants,
    suffix_dedup,
    token_alignment,
    toxicity,
    trie_bpe,
    weighted_minhash,
    wrapper,
)
from tokengrove.llm.base import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A published vocabulary that the environment installs, the byte-level one unless named."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op2_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op4_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_index.archive_round_trip(table(spark, sf_dir, "pages"))


def op5_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.digest_encoding(table(spark, sf_dir, "documents"), trie_bpe.read_model(tokenizer_path()))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract_text(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotated_digests(table(spark, sf_dir, "conversations"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_alignment.align_tokens(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_language_id,
        op2_weighted_minhash,
        op3_embedding_dedup,
        op4_capture_index,
        op5_trie_bpe,
        op6_toxicity,
        op7_wrapper,
        op8_quality_rules,
        op9_mixing,
        op10_perspectives,
        op11_suffix_dedup,
        op12_token_alignment,
        op13_spelling_variants,
    )
}

ORACLES: dict[str, str] = {
    "op4_capture_index": capture_index.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op10_perspectives": perspectives.ORACLE,
    "op11_suffix_dedup": suffix_dedup.ORACLE,
    "op13_spelling_variants": spelling_variants.ORACLE,
}
