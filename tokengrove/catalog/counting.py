"""Byte-pair token counts.

No vocabulary file is at hand here, so these queries use one made by a rule: all bytes,
and pairs of equal letters. Greedy merging under it halves runs of a letter, which SQL
can say with a regular expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokengrove.catalog.base import CORPUS, over_corpus, register
from tokengrove.catalog.prompts import PROMPT_SQL
from tokengrove.functions.tokens import Tokenizer, register_tokenizer
from tokengrove.operators.counting import count_files, prompt_tokens
from tokengrove.operators.render import all_pieces
from tokengrove.sources.tables import documents_corpus as corpus

# Letters of no English contraction, so that ``'s`` and the like never part a pair.
_DOUBLED = "abcfghijknopquwxyz"


def pair_tokenizer(name: str = "cl100k") -> Tokenizer:
    ranks = {bytes([b]): b for b in range(256)}
    for i, letter in enumerate(_DOUBLED):
        ranks[letter.encode() * 2] = 256 + i
    return register_tokenizer(name, ranks=ranks)


_PAIRS = "|".join(c * 2 for c in _DOUBLED)


def _count(column: str) -> str:
    return (
        f"CAST(strlen({column}) - len(regexp_extract_all({column}, '{_PAIRS}')) AS BIGINT)"
    )


def _tokens_query(name: str, encoding: str) -> None:
    @register(name, over_corpus(f"SELECT repo, rel_path, {_count('content')} AS tokens FROM corpus"))
    def _(spark: SparkSession, sf: str) -> DataFrame:
        return count_files(corpus(spark, sf), pair_tokenizer(encoding)).select(
            "repo", "rel_path", "tokens"
        )


_tokens_query("bpe_tokens", "cl100k")
_tokens_query("bpe_tokens_gpt2", "gpt2")
_tokens_query("bpe_tokens_p50k_base", "p50k_base")
_tokens_query("bpe_tokens_p50k_edit", "p50k_edit")


@register("bpe_tokens_specials", over_corpus(f"""
SELECT repo, rel_path, {_count('content')} + 2 AS tokens FROM corpus"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("<|endoftext|>"), "content", F.lit("<|endofprompt|>"))
    return count_files(corpus(spark, sf).withColumn("content", text), pair_tokenizer("o200k_base")).select(
        "repo", "rel_path", "tokens"
    )


@register("prompt_bpe_tokens", f"WITH {CORPUS}, {PROMPT_SQL} SELECT repo, {_count('prompt')} AS tokens FROM prompts")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return prompt_tokens(all_pieces(corpus(spark, sf)), pair_tokenizer())


@register("prompt_bpe_tokens_parts", f"WITH {CORPUS}, {PROMPT_SQL} SELECT repo, {_count('prompt')} AS tokens FROM prompts")
def _(spark: SparkSession, sf: str) -> DataFrame:
    pieces = all_pieces(corpus(spark, sf))
    return prompt_tokens(pieces, pair_tokenizer("r50k_base"), part_bytes=1 << 12)
