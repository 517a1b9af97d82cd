"""The scan cache. The cache is an earlier state of the corpus: some files unknown, some changed since."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokengrove.catalog.base import over_corpus, register
from tokengrove.operators import cache
from tokengrove.plans.lineage import work_dir
from tokengrove.sources.tables import documents_corpus as corpus

TOKENIZER = "bytes4"


def file_number():
    """The number in a file's name, by which the earlier state differs."""
    return F.regexp_extract("rel_path", r"d(\d+)(?:\.[^.]*)?$", 1).cast("bigint")


_CACHE = """
, cached AS (
  SELECT repo, rel_path,
         CASE WHEN doc_id % 5 = 1 THEN mtime_us - 1000000 ELSE mtime_us END AS mtime_us,
         CASE WHEN doc_id % 5 = 2 THEN size + 1 ELSE size END AS size,
         CASE WHEN doc_id % 7 = 3 THEN 'other' ELSE 'bytes4' END AS tokenizer,
         tokens + 1 AS tokens, 'old ' || content AS content,
         CASE WHEN doc_id % 11 = 5 THEN 0 ELSE 1 END AS cache_version, doc_id
  FROM corpus WHERE doc_id % 5 <> 0
)
"""


def earlier_cache(files: DataFrame) -> DataFrame:
    old = F.concat(F.lit("old "), "content")
    n = file_number()
    return files.where(n % 5 != 0).select(
        "repo",
        "rel_path",
        F.when(n % 5 == 1, F.col("mtime_us") - 1000000).otherwise(F.col("mtime_us")).alias("mtime_us"),
        F.when(n % 5 == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.sha2(old, 256).alias("sha256"),
        F.when(n % 7 == 3, "other").otherwise(TOKENIZER).alias("tokenizer"),
        (F.col("tokens") + 1).alias("tokens"),
        old.alias("content"),
        F.when(n % 11 == 5, 0).otherwise(cache.CACHE_VERSION).alias("cache_version"),
    )


def written_cache(files: DataFrame) -> str:
    """The earlier state as an indexed table."""
    path = work_dir(files.sparkSession, "cache")
    cache.write_cache(earlier_cache(files), path)
    return path


_LOOKUP = over_corpus(_CACHE + """
SELECT f.repo, f.rel_path, c.tokens, c.repo IS NOT NULL AS hit
FROM corpus f LEFT JOIN cached c ON c.repo = f.repo AND c.rel_path = f.rel_path
  AND c.mtime_us = f.mtime_us AND c.size = f.size AND c.tokenizer = 'bytes4' AND c.cache_version = 1""")


@register("cache_lookup_indexed", _LOOKUP)
def _(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf)
    listing = files.select(*cache.LOOKUP_KEY)
    known = cache.narrowed_cache(listing, written_cache(files))
    return cache.cache_lookup(listing, known, TOKENIZER).select("repo", "rel_path", "tokens", "hit")


@register("cache_lookup", _LOOKUP)
def _(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf)
    return cache.cache_lookup(files, earlier_cache(files), TOKENIZER).select(
        "repo", "rel_path", "tokens", "hit"
    )


@register("cache_misses", over_corpus(_CACHE + """
SELECT repo, rel_path, tokens FROM corpus f WHERE NOT EXISTS (
  SELECT 1 FROM cached c WHERE c.repo = f.repo AND c.rel_path = f.rel_path
  AND c.mtime_us = f.mtime_us AND c.size = f.size AND c.tokenizer = 'bytes4' AND c.cache_version = 1)"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf)
    return cache.cache_misses(files, earlier_cache(files), TOKENIZER).select(
        "repo", "rel_path", "tokens"
    )


@register("cache_upsert", over_corpus(_CACHE + """
, fresh AS (
  SELECT * FROM corpus f WHERE NOT EXISTS (
    SELECT 1 FROM cached c WHERE c.repo = f.repo AND c.rel_path = f.rel_path
    AND c.mtime_us = f.mtime_us AND c.size = f.size AND c.tokenizer = 'bytes4' AND c.cache_version = 1)
)
SELECT repo, rel_path, mtime_us, size, sha256(content) AS sha256, tokenizer, tokens, content, cache_version
FROM cached WHERE doc_id NOT IN (SELECT doc_id FROM fresh)
UNION ALL
SELECT repo, rel_path, mtime_us, size, sha256(content), 'bytes4', tokens, content, 1 FROM fresh"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf)
    old = earlier_cache(files)
    fresh = cache.cache_rows(cache.cache_misses(files, old, TOKENIZER), TOKENIZER)
    return cache.cache_upsert(old, fresh)


_CONTENT = over_corpus(_CACHE + """
SELECT f.repo, f.rel_path, COALESCE(c.content, f.content) AS content
FROM corpus f LEFT JOIN cached c ON c.repo = f.repo AND c.rel_path = f.rel_path
  AND c.mtime_us = f.mtime_us AND c.size = f.size AND c.tokenizer = 'bytes4' AND c.cache_version = 1""")


@register("cache_content_indexed", _CONTENT)
def _(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf)
    listing = files.select(*cache.LOOKUP_KEY)
    known = cache.narrowed_cache(listing, written_cache(files))
    return cache.cache_content(listing, known, files, TOKENIZER).select("repo", "rel_path", "content")


@register("cache_content", _CONTENT)
def _(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf)
    listing = files.select(*cache.LOOKUP_KEY)
    return cache.cache_content(listing, earlier_cache(files), files, TOKENIZER).select("repo", "rel_path", "content")
