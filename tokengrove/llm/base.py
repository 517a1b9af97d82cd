"""What the operators share: reading tables, held-out rows, bounded samples, slices of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
import sys

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word, for sizes and shingles: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that the vectorised scorers hold at a time; a longer text is a slice by itself.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession, model: object) -> Broadcast:
    """Broadcast a model as bytes, classes of this package by value; tasks read it by :func:`opened`."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


_SLOT = "_tokengrove_opened_model"


def opened(shared: Broadcast):
    """The model in this Python worker, with all that it remembers from earlier tasks.

    A worker outlives its tasks and keeps every broadcast; it keeps one opened model, the last.
    """
    payload = shared.value
    key = (len(payload), hash(payload))
    held = getattr(sys, _SLOT, None)
    if held is None or held[0] != key:
        held = (key, cloudpickle.loads(payload))
        setattr(sys, _SLOT, held)
    return held[1]


def held_out(doc_id: str | Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, mod 5, is 0. A null id is not."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def unit_hash(*cols: str | Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the columns and the seed only: 52 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def size_slices(sizes: Iterable[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of these sizes, of about ``limit`` together."""
    start = stop = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
        stop = i + 1
    if start < stop:
        yield start, stop


def text_slices(texts: Sequence[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters, so that arrays over a slice stay small."""
    return size_slices((len(text or "") for text in texts), limit)


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_chars: int = 200_000,
    skip_held_out: bool = True,
) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """A bounded sample ``[(text, 0 or 1)]`` for fitting a classifier, and the label counts.

    Of each class it takes the ``per_class`` labelled ids of the smallest hash, so reruns agree.
    It is chosen on the labels alone: at most ``2 * per_class`` ids meet the documents, which
    is also what proves the broadcast small. Texts above ``max_chars`` are no examples, which
    bounds the bytes on the driver.
    """
    rows = labels.select(
        F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")
    ).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
    if skip_held_out:
        rows = rows.where(~held_out("_id"))
    counts = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = rows.where(F.col("_y") == y).distinct().orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .where(F.length("_text") <= max_chars)
        .join(F.broadcast(chosen), "_id")
        .select("_id", "_text", "_y")
    )
    sample = sorted((r["_id"], r["_y"], r["_text"]) for r in found.collect())
    return [(text, y) for _, y, text in sample], counts
