"""The scan cache: token counts and bodies of files that have not changed.

Cache schema: ``repo, rel_path, mtime_us, size, sha256, tokenizer, tokens, content,
cache_version``; one row per ``(repo, rel_path)``. The tokenizer and the version are
part of the lookup, so a count never comes from another encoding or an old format.

:func:`write_cache` lays a cache out by path, with a bloom filter of the file keys in each row group.
:func:`narrowed_cache` reads from it what a listing can meet, and stands for the whole cache in every
function below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tokengrove.functions.text import sha256_hex

CACHE_VERSION = 1
FILE_KEY = ["repo", "rel_path"]
LOOKUP_KEY = ["repo", "rel_path", "mtime_us", "size"]
CACHE_COLUMNS = [
    "repo",
    "rel_path",
    "mtime_us",
    "size",
    "sha256",
    "tokenizer",
    "tokens",
    "content",
    "cache_version",
]

#: Names a file in the index; two files may share one, so lookups compare the whole key as well.
FILE_HASH = "file_hash"
GROUP_BYTES = 16 << 20
#: So many files or repositories of a listing are named to the scan, which tests each against every row group.
FEW = 256


def _current(cache: DataFrame, tokenizer: str) -> DataFrame:
    return cache.where(
        (F.col("tokenizer") == tokenizer) & (F.col("cache_version") == CACHE_VERSION)
    )


def cache_lookup(listing: DataFrame, cache: DataFrame, tokenizer: str) -> DataFrame:
    """``listing`` with ``tokens`` of cache hits, null for misses, and ``hit``. No body is read."""
    known = _current(cache, tokenizer).select(
        *LOOKUP_KEY, F.col("tokens"), F.lit(True).alias("hit")
    )
    return (
        listing.drop("tokens")
        .join(known, LOOKUP_KEY, "left")
        .withColumn("hit", F.coalesce("hit", F.lit(False)))
    )


def cache_misses(listing: DataFrame, cache: DataFrame, tokenizer: str) -> DataFrame:
    """The rows to recompute."""
    known = _current(cache, tokenizer).select(*LOOKUP_KEY)
    return listing.join(known, LOOKUP_KEY, "left_anti")


def cache_rows(files: DataFrame, tokenizer: str) -> DataFrame:
    """Cache rows of counted files; a file without a count is not cached."""
    return files.where(F.col("tokens").isNotNull()).select(
        *LOOKUP_KEY,
        sha256_hex(F.col("content")).alias("sha256"),
        F.lit(tokenizer).alias("tokenizer"),
        "tokens",
        "content",
        F.lit(CACHE_VERSION).alias("cache_version"),
    )


def cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache after ``fresh`` rows replaced those of the same file. Write it to a new path."""
    kept = cache.join(fresh.select(*FILE_KEY), FILE_KEY, "left_anti")
    return kept.select(*CACHE_COLUMNS).unionByName(fresh.select(*CACHE_COLUMNS))


def cache_content(listing: DataFrame, cache: DataFrame, source: DataFrame, tokenizer: str) -> DataFrame:
    """``listing`` with ``content``: of cache hits from the cache, of the others from ``source``.

    A hit agrees in path, time, size, tokenizer and version, so a changed file never gets an
    earlier body, and only files that are no hits meet ``source``.
    """
    known = _current(cache, tokenizer).select(*LOOKUP_KEY, "content")
    entries = listing.drop("content")
    hits = entries.join(known, LOOKUP_KEY)
    read = source.select(*FILE_KEY, "content")
    missed = entries.join(known.select(*LOOKUP_KEY), LOOKUP_KEY, "left_anti").join(read, FILE_KEY, "left")
    columns = [*entries.columns, "content"]
    return hits.select(*columns).unionByName(missed.select(*columns))


def write_cache(cache: DataFrame, path: str, group_bytes: int = GROUP_BYTES) -> None:
    """``cache`` as a new table at ``path`` that :func:`narrowed_cache` can read in part.

    Rows are range-partitioned and sorted by repository and path, so a repository of any size spreads and a
    row group holds neighbours: the statistics of its paths find repositories, a bloom filter single files.
    A row group is written at about ``group_bytes``, what a lookup of one file reads at least.
    """
    hashes = max(64, group_bytes // 128)  # more than a row group has files; the filter takes about 1 % of it
    (
        cache.select(*CACHE_COLUMNS, F.xxhash64(*FILE_KEY).alias(FILE_HASH))
        .repartitionByRange(*FILE_KEY)
        .sortWithinPartitions(*FILE_KEY)
        .write.option("parquet.block.size", group_bytes)
        .option(f"parquet.bloom.filter.enabled#{FILE_HASH}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{FILE_HASH}", hashes)
        .parquet(path)
    )


def _any_of(column: str, values: list) -> Column:
    """Equal to one of ``values``, as a balanced tree of equalities.

    The scan tests each of these against statistics and bloom filters; of a longer ``IN`` it uses the ends only.
    """
    if not values:
        return F.lit(False)
    tests = [F.col(column) == F.lit(v) for v in values]
    while len(tests) > 1:
        pairs = [a | b for a, b in zip(tests[::2], tests[1::2])]
        tests = pairs + tests[2 * len(pairs) :]
    return tests[0]


def narrowed_cache(listing: DataFrame, path: str, few: int = FEW) -> DataFrame:
    """The rows of the cache at ``path`` that ``listing`` may hit, and perhaps others.

    The scan is told the files if there are at most ``few``, else the repositories if those are, else
    nothing. Row groups without them are not read. The driver sees at most ``few`` and one of either.
    Looking up in the result equals looking up in the whole cache. A null in a file's key hits nothing.
    """
    spark = listing.sparkSession
    cache = spark.read.parquet(path)
    named = listing.select(*FILE_KEY).dropna()
    files = [r[0] for r in named.select(F.xxhash64(*FILE_KEY)).limit(few + 1).collect()]
    if len(files) <= few:
        return cache.where(_any_of(FILE_HASH, sorted(set(files))))
    repos = [r[0] for r in named.select("repo").distinct().limit(few + 1).collect()]
    return cache.where(_any_of("repo", sorted(repos))) if len(repos) <= few else cache
