"""Scanning a directory tree that Spark lays out from the documents, and scanning by stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import suppress
from itertools import repeat
import os
import time

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tokengrove.catalog.base import ORACLES, over_corpus, register
from tokengrove.catalog.caching import TOKENIZER, earlier_cache, file_number
from tokengrove.functions.text import sha256_hex
from tokengrove.operators.cache import cache_rows
from tokengrove.plans.lineage import cut, discard, work_dir
from tokengrove.sources import files as source
from tokengrove.sources.tables import documents_corpus as corpus, read_table
from tokengrove.sources.tree_source import SETTLED_US, read_tree
from tokengrove.streaming.incremental import append_batch, current_cache, incremental_scan, scan_stream


#: A tree is laid out and scanned in waves of about so many bytes, or those of all texts if these are more.
WAVE_BYTES = 256 << 20
_BLOCK = 4096  # what a file takes at least on most file systems


def lay_out(files: DataFrame, folder: str) -> None:
    """Write ``(repo, rel_path, content)`` as files below ``folder/repo``, the same if run twice.

    With a column ``times`` a file has its content so often; only one copy of it leaves the JVM.
    """
    times = F.col("times") if "times" in files.columns else F.lit(1)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for repo, rel_path, content, times in batch.itertuples(index=False):
                path = os.path.join(folder, repo, rel_path)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                partial = f"{path}.{os.getpid()}.partial"
                with open(partial, "wb") as f:
                    f.writelines(repeat(content if isinstance(content, bytes) else content.encode(), times))
                os.replace(partial, path)
            yield pd.DataFrame({"written": [len(batch)]})

    rows = _few_tasks(files.select("repo", "rel_path", "content", times.alias("times")))
    rows.mapInPandas(write, "written bigint").agg(F.sum("written")).collect()


def _few_tasks(files: DataFrame) -> DataFrame:
    """Two tasks for each core: a wave takes few rows of many splits, and each Python task costs as much as some files."""
    return files.coalesce(2 * files.sparkSession.sparkContext.defaultParallelism)


def clear(files: DataFrame, folder: str) -> None:
    """Remove the files that :func:`lay_out` wrote for ``(repo, rel_path)`` and the directories that this empties; nothing else, and none twice."""

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for repo, rel_path in batch.itertuples(index=False):
                at = os.path.join(folder, repo, rel_path)
                with suppress(FileNotFoundError):
                    os.remove(at)
                with suppress(OSError):  # the first that is not empty
                    while at != folder:
                        at = os.path.dirname(at)
                        os.rmdir(at)
            yield pd.DataFrame({"removed": [len(batch)]})

    rows = _few_tasks(files.select("repo", "rel_path"))
    rows.mapInPandas(remove, "removed bigint").agg(F.sum("removed")).collect()


def _odd_files(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as files, some of them empty, not UTF-8 or long (``times`` their text), with the bytes ``_takes`` of each on disk."""
    files = corpus(spark, sf)
    n = F.regexp_extract("rel_path", r"d(\d+)(?:\.[^.]*)?$", 1).cast("bigint")
    raw = F.encode("content", "UTF-8")
    body = (
        F.when(n % 19 == 3, F.lit("").cast("binary"))
        .when(n % 19 == 4, F.concat(raw, F.unhex(F.lit("FFFE"))))
        .otherwise(raw)
    )
    times = F.when(n % 19 == 5, 400).otherwise(1)
    takes = F.ceil(F.col("size") * times / _BLOCK) * _BLOCK
    return files.withColumns({"content": body, "times": times, "_takes": takes})


def _in_waves(
    spark: SparkSession,
    sf: str,
    scan: Callable[[DataFrame, str], DataFrame],
    ignore_files: bool = False,
) -> DataFrame:
    """What ``scan(roots, folder)`` finds in the documents laid out as files below the shared folder.

    The tree is many times as large as the texts, so it stands on disk in waves: a share of the files of every directory
    is laid out, scanned, the result written, the files removed. There are as many waves as the tree is
    larger than ``WAVE_BYTES`` or the texts: smaller ones take less disk, but each costs some jobs and reads all texts.
    Every file is in one wave; ignore files are in all.
    Files in directories need a folder that executors can mount: these queries raise on others.
    """
    files = _odd_files(spark, sf)
    laid, texts = files.agg(F.sum("_takes"), F.sum("size")).first()
    waves = max(1, -(-int(laid or 0) // max(WAVE_BYTES, int(texts or 0))))
    repos = cut(files.select("repo").distinct())
    columns = ["repo", "rel_path", "content", "times"]
    rules = [
        F.struct(F.lit(path).alias("rel_path"), F.encode(F.lit(lines), "UTF-8").alias("content"), F.lit(1).alias("times"))
        for path, lines in (IGNORE_FILES.items() if ignore_files else ())
    ]
    found = work_dir(spark, "found")
    for wave in range(waves):
        folder = source.local_path(work_dir(spark, "tree"))
        here = files.where(F.pmod(F.xxhash64("rel_path"), F.lit(waves)) == wave).select(*columns)
        if rules:
            here = here.unionByName(repos.select("repo", F.inline(F.array(*rules))).select(*columns))
        lay_out(here, folder)
        rows = scan(repos.withColumn("root", F.concat(F.lit(folder + "/"), "repo")), folder)
        rows.write.mode("append").parquet(found)
        clear(here, folder)
    return spark.read.schema(rows.schema).parquet(found)


IGNORE_FILES = {".gitignore": "m3/\n*.TOML\n", "en/.gitignore": "*.py\n!d*0.py\n", "en/.ignore": "!d*1.py\n"}


def _shown(files: DataFrame) -> DataFrame:
    return files.select(
        "repo", "rel_path", "ext", "is_symlink", "size", "tokens", sha256_hex(F.col("content")).alias("digest")
    )


def _scanned(spark: SparkSession, sf: str, hidden: bool) -> DataFrame:
    return _in_waves(spark, sf, lambda roots, _: _shown(source.scan_files(spark, roots, hidden=hidden)))


def _scan_sql(where: str) -> str:
    return over_corpus(f"""
, disk AS (
  SELECT *, doc_id % 19 AS k, CASE WHEN doc_id % 19 = 5 THEN 400 ELSE 1 END AS times FROM corpus
)
SELECT repo, rel_path, CASE WHEN ext IS NOT NULL THEN ext END AS ext, false AS is_symlink,
       CAST(size * times AS BIGINT) AS size, CAST((size * times + 3) // 4 AS BIGINT) AS tokens,
       sha256(repeat(content, times)) AS digest
FROM disk WHERE k NOT IN (3, 4) AND size * times BETWEEN 1 AND 1048576 AND {where}""")


@register("scan_files", _scan_sql("NOT starts_with(rel_path, '.')"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _scanned(spark, sf, hidden=False)


@register("scan_files_hidden", _scan_sql("true"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _scanned(spark, sf, hidden=True)


_NOT_IGNORED = """NOT starts_with(rel_path, '.') AND NOT list_contains(parts, 'm3') AND COALESCE(ext, '') <> 'TOML'
  AND NOT (starts_with(rel_path, 'en/') AND COALESCE(ext, '') = 'py' AND doc_id % 10 NOT IN (0, 1))"""


@register("scan_ignored", _scan_sql(_NOT_IGNORED))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _in_waves(spark, sf, lambda roots, _: _shown(source.scan_files(spark, roots)), ignore_files=True)


@register("scan_globs", _scan_sql("""NOT starts_with(rel_path, '.') AND COALESCE(ext, '') IN ('py', 'md')
  AND NOT (list_contains(parts, 'sub') AND list_contains(parts, 'm2'))"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    globs = {"include": ["**/*.{py,md}"], "exclude": ["**/m2/sub/**"]}
    return _in_waves(spark, sf, lambda roots, _: _shown(source.scan_files(spark, roots, **globs)))


def _by_repo(files: DataFrame) -> DataFrame:
    """Files of one tree whose top directories are repositories."""
    return files.withColumns(
        {
            "repo": F.substring_index("rel_path", "/", 1),
            "rel_path": F.regexp_replace("rel_path", r"^[^/]*/", ""),
        }
    )


@register("scan_source", _scan_sql(_NOT_IGNORED + """ AND COALESCE(ext, '') IN ('py', 'md') AND size * times >= 500
  AND NOT (list_contains(parts, 'sub') AND list_contains(parts, 'm2'))"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """All repositories as one tree, read as a data source that is asked for extensions, sizes and globs."""

    def scan(_: DataFrame, folder: str) -> DataFrame:
        tree = read_tree(spark, folder, "ext in ('py', 'md') and size >= 500", exclude='["**/m2/sub/**"]')
        return _shown(_by_repo(tree))

    return _in_waves(spark, sf, scan, ignore_files=True)


@register("scan_stream", f"""
SELECT repo, rel_path, size, tokens, digest FROM ({_scan_sql("NOT starts_with(rel_path, '.')")})""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The tree followed by a stream: a first run finds it, a second one finds nothing new."""

    def scan(_: DataFrame, folder: str) -> DataFrame:
        table, checkpoint = work_dir(spark, "tree-cache"), work_dir(spark, "tree-progress")
        time.sleep(2 * SETTLED_US / 1e6)
        for _ in range(2):
            scan_stream(spark, folder, table, checkpoint).awaitTermination()
        found = cut(
            _by_repo(current_cache(spark, table)).select(
                "repo", "rel_path", "size", "tokens", F.col("sha256").alias("digest")
            )
        )
        discard(spark, table)
        return found

    return _in_waves(spark, sf, scan)


@register("scan_cached", _scan_sql("NOT starts_with(rel_path, '.')").replace(
    "AS tokens", "+ CASE WHEN doc_id % 3 = 1 THEN 7 ELSE 0 END AS tokens").replace(
    "sha256(repeat(content, times))", "sha256(CASE WHEN doc_id % 3 = 1 THEN 'kept' ELSE repeat(content, times) END)"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the files are known from a scan before, with a body and a count that tell."""

    def scan(roots: DataFrame, _: str) -> DataFrame:
        known = source.scan_files(spark, roots).where(file_number() % 3 == 1)
        cache = cache_rows(known.withColumns({"content": F.lit("kept"), "tokens": F.col("tokens") + 7}), TOKENIZER)
        return _shown(source.scan_files(spark, roots, cache=cut(cache), tokenizer=TOKENIZER))

    return _in_waves(spark, sf, scan)


@register("incremental_scan")
def _(spark: SparkSession, sf: str) -> DataFrame:
    table, checkpoint = work_dir(spark, "scan-cache"), work_dir(spark, "scan-progress")
    append_batch(spark, table, earlier_cache(corpus(spark, sf)), 0)
    # The table is a file or a folder of them: a pattern matches either.
    arriving = spark.readStream.schema(read_table(spark, sf, "documents").schema).parquet(f"{sf}/documents.parque[t]")
    incremental_scan(corpus(spark, sf, arriving), table, checkpoint, TOKENIZER).awaitTermination()
    return current_cache(spark, table)


ORACLES["incremental_scan"] = ORACLES["cache_upsert"]
