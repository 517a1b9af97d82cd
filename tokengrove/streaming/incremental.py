"""Keeping a scan cache current from a stream of files.

The cache is a log of folders ``run=N/batch=M``. A run is one checkpoint: its number is drawn
when a checkpoint first writes, above all numbers before it, and kept beside the checkpoint, so a
stream that starts anew appends after what is there. The newest row of a file is that of the
highest run and batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tokengrove.operators.cache import CACHE_COLUMNS, FILE_KEY, LOOKUP_KEY, cache_misses, cache_rows
from tokengrove.plans.lineage import cut, discard, work_dir
from tokengrove.sources.tree_source import register_tree_source

CACHE_SCHEMA = (
    "repo string, rel_path string, mtime_us bigint, size bigint, sha256 string, "
    "tokenizer string, tokens bigint, content string, cache_version int"
)
_LOG_SCHEMA = CACHE_SCHEMA + ", run bigint, batch bigint"
GONE = -1  # the version of a row that tells that its file is no more


def _log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_LOG_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LOG_SCHEMA)


def _latest(log: DataFrame) -> DataFrame:
    place = F.struct("run", "batch")
    newest = log.groupBy(*FILE_KEY).agg(F.max(place).alias("_p")).select(*FILE_KEY, "_p.*")
    return log.join(newest, [*FILE_KEY, "run", "batch"], "left_semi").select(*CACHE_COLUMNS)


def current_cache(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each file, without files that are gone."""
    return _latest(_log(spark, path)).where(F.col("cache_version") != GONE)


def append_batch(spark: SparkSession, path: str, rows: DataFrame, batch: int, run: int = 0) -> None:
    """Write one batch of cache rows as its own folder; writing it again replaces it."""
    rows.select(*CACHE_COLUMNS).write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch}")


def compact_cache(spark: SparkSession, path: str, into: str) -> None:
    """Write the newest rows as the first run of a new cache; point later streams to that."""
    append_batch(spark, into, current_cache(spark, path), 0)


def _run_of(spark: SparkSession, path: str, checkpoint: str) -> int:
    """The number of the checkpoint's run, drawn and kept when it has none yet."""
    note = f"{checkpoint}-run"
    try:
        return spark.read.schema("run bigint").parquet(note).first()["run"]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    latest = _log(spark, path).agg(F.max("run").alias("run")).first()["run"]
    run = 0 if latest is None else latest + 1
    spark.createDataFrame([(run,)], "run bigint").coalesce(1).write.parquet(note)
    return run


def _newest(batch: DataFrame) -> DataFrame:
    """One row of each file's newest version."""
    arrived = batch.dropDuplicates(LOOKUP_KEY)
    version = F.struct("mtime_us", "size")
    newest = arrived.groupBy(*FILE_KEY).agg(F.max(version).alias("_v")).select(*FILE_KEY, "_v.*")
    return arrived.join(newest, LOOKUP_KEY, "left_semi")


def _newest_of_written(batch: DataFrame) -> DataFrame:
    """:func:`_newest` of a table. Contents of files that arrived once, in a tree all, stay where they are
    as long as Spark can broadcast the names of the others."""
    again = cut(batch.groupBy(*FILE_KEY).count().where("count > 1").select(*FILE_KEY))
    once = batch.dropna(subset=LOOKUP_KEY).join(again, FILE_KEY, "left_anti")
    return once.unionByName(_newest(batch.join(again, FILE_KEY, "left_semi")))


def incremental_scan(
    files: DataFrame,
    path: str,
    checkpoint: str,
    tokenizer: str = "bytes4",
    count: Callable[[DataFrame], DataFrame] = lambda df: df,
    present: Callable[[SparkSession], DataFrame] | None = None,
) -> StreamingQuery:
    """Process all files now available in the stream ``files`` into the cache at ``path``.

    Per micro-batch, files the cache already knows are dropped and the rest counted by
    ``count`` and appended. A batch looks only at what was written before it and overwrites its
    own folder, so a batch replayed after a failure leaves the same cache. Nothing already
    written is rewritten, whatever the size of the cache; :func:`compact_cache` shortens it.
    One stream writes to a cache at a time.

    ``present`` lists the files ``(repo, rel_path)`` that exist when a batch runs; cached files it does not list
    get a row that says they are gone.
    """
    spark = files.sparkSession
    run = _run_of(spark, path, checkpoint)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        earlier = (F.col("run") < run) | (F.col("run") == run) & (F.col("batch") < batch_id)
        known = _latest(_log(own, path).where(earlier))
        if present is not None:  # files may change while they are read again
            written = work_dir(own, "batch")
            batch.write.parquet(written)
            batch = own.read.schema(batch.schema).parquet(written)
            arrived = _newest_of_written(batch)
        else:
            arrived = _newest(batch)
        fresh = count(cache_misses(arrived, known, tokenizer))
        rows = cache_rows(fresh, tokenizer)
        if present is not None:
            missing = known.where(F.col("cache_version") != GONE).join(present(own).select(*FILE_KEY), FILE_KEY, "left_anti")
            empty = {c: F.lit(None).cast(missing.schema[c].dataType) for c in ("sha256", "tokens", "content")}
            rows = rows.unionByName(missing.withColumns(empty | {"cache_version": F.lit(GONE)}))
        append_batch(own, path, rows, batch_id, run)
        if present is not None:
            discard(own, written)

    return (
        files.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def scan_stream(
    spark: SparkSession,
    root: str,
    path: str,
    checkpoint: str,
    tokenizer: str = "bytes4",
    count: Callable[[DataFrame], DataFrame] = lambda df: df,
    **options: str,
) -> StreamingQuery:
    """Keep the cache at ``path`` current with the directory tree at ``root``.

    Each run takes in files that were added, changed or moved since the last one with the same checkpoint, and marks those
    that are gone. ``options`` are those of the ``file_tree`` source.
    """
    register_tree_source(spark)
    options = {"path": root, **options}

    def present(own: SparkSession) -> DataFrame:
        register_tree_source(own)
        return own.read.format("file_tree").options(**options, content="false").load()

    files = spark.readStream.format("file_tree").options(**options).load()
    return incremental_scan(files, path, checkpoint, tokenizer, count, present)
