"""Ordered concatenation of text whose groups may exceed any cell, task or driver.

A text is given as pieces: rows with a group, an order and a ``text``. The result is
the whole text cut into parts, ``(group, part, text)``, such that concatenating the
parts in order gives exactly the text. A piece goes to the part in which its first
byte falls, so a part holds at most ``part_bytes`` plus one piece, and a text below
``part_bytes`` is a single part 0.

Pieces are written once, with their sizes. A group of moderate size is one slice; a
larger one is cut into slices of whole parts, whose first orders are found from the sizes
alone. Texts are then shuffled once, by group and slice: offsets are running sums inside a slice
that add to where it starts, and a part lies in one slice, so the same exchange serves both.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tokengrove.functions.text import trim_all, trim_end, trim_start
from tokengrove.plans.lineage import cut
from tokengrove.plans.skew import salted_join
from tokengrove.plans.slices import running

PART_BYTES = 64 * 1024 * 1024
#: Slices of large groups hold at least this share of all bytes, which bounds the list of their starts.
MOST_SLICES = 100_000
#: Every Python worker holds that list. So small parts share a slice: beyond ``FEW_SLICES`` a slice holds ``SLICE_BYTES``.
FEW_SLICES, SLICE_BYTES = 500, 16 << 20
#: Finished parts leave a task's worker in batches of about so much.
FLUSH_BYTES, FLUSH_ROWS = 4 << 20, 10_000


def write_pieces(pieces: DataFrame, group: Sequence[str], order: Sequence[str], **extra: Column) -> DataFrame:
    """Pieces as a table, with the sizes that :func:`placed_pieces` needs; ``extra`` columns are computed along."""
    return cut(
        pieces.select(
            *group,
            *order,
            F.coalesce("text", F.lit("")).alias("text"),
            F.octet_length("text").cast("bigint").alias("_bytes"),
            (trim_all(F.col("text")) != "").cast("bigint").alias("_solid"),
            *[column.alias(name) for name, column in extra.items()],
        )
    )


def _ordered(values) -> tuple:
    """A key that Python orders as Spark does: nulls first, arrays element by element."""
    if values is None:
        return ()
    if isinstance(values, str) or not hasattr(values, "__iter__"):
        return (values,)
    return (tuple(_ordered(v) for v in values),)


def _slice_parts(total: int, part_bytes: int) -> int:
    """How many parts a slice holds, of groups with ``total`` bytes together."""
    return max(1, max(total // MOST_SLICES, min(total // FEW_SLICES, SLICE_BYTES)) // part_bytes)


def _slices(
    rows: DataFrame, large: DataFrame, group: list[str], order: list[str], slice_parts: int, part_bytes: int
) -> DataFrame:
    """``rows`` of large groups with ``_slice`` and what lies before it: bytes, solid pieces, and both of the whole group.

    Only keys and sizes are sorted; the first order of each slice is sent to all tasks, at most
    two for each of ``MOST_SLICES``.
    """
    sizes = salted_join(rows.select(*group, *order, "_bytes", "_solid"), large, group, "left_semi", order)
    offsets = running(
        sizes,
        group,
        [F.col(c) for c in order],
        {"_at": F.col("_bytes"), "_before": F.col("_solid")},
        {"_all": "_before"},
    )
    part = F.floor(F.col("_at") / F.lit(part_bytes)).cast("bigint")
    # Numbers may be skipped where a piece is larger than a slice; places in the list are not.
    dense = F.row_number().over(Window.partitionBy(*group).orderBy("_number")) - 1
    starts = cut(
        offsets.groupBy(*group, F.floor(part / F.lit(slice_parts)).cast("bigint").alias("_number"))
        .agg(F.min(F.struct(*order, "_at", "_before", "_all")).alias("_first"), F.max("_at").alias("_end"))
        .select(
            *group,
            dense.cast("int").alias("_slice"),
            "_first.*",
            F.max("_end").over(Window.partitionBy(*group)).alias("_end"),
        )
    )
    known: dict[tuple, list[tuple]] = {}
    for row in starts.orderBy(*group, "_slice").select(*group, *order).collect():
        known.setdefault(_ordered(row[: len(group)]), []).append(_ordered(row[len(group) :]))
    shipped = rows.sparkSession.sparkContext.broadcast(known)
    width = len(group)

    @F.arrow_udf("int")
    def slice_of(keys: pa.Array) -> pa.Array:
        firsts = shipped.value
        out = []
        for row in zip(*(values.to_pylist() for values in keys.flatten())):
            found = firsts.get(_ordered(row[:width]))
            out.append(bisect_right(found, _ordered(row[width:])) - 1 if found else 0)
        return pa.array(out, pa.int32())

    sliced = rows.withColumn("_slice", slice_of(F.struct(*group, *order)))
    return sliced.join(F.broadcast(starts.drop(*order)), [*group, "_slice"], "left")


def placed_pieces(
    pieces: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    part_bytes: int = PART_BYTES,
    trim: bool = False,
    written: bool = False,
) -> DataFrame:
    """``pieces`` with their ``part``, the last one of their group, ``_last``, and ``_slice``; with
    ``trim`` the text as a whole is trimmed.

    ``written`` tells that the pieces come from :func:`write_pieces`. The result is partitioned by
    group and slice, which is what :func:`join_parts` needs.
    """
    group, order = list(group), list(order)
    rows = pieces if written else write_pieces(pieces, group, order)
    sizes = rows.groupBy(*group).agg(F.sum("_bytes").alias("_size"))
    total, largest = sizes.agg(F.sum("_size"), F.max("_size")).first()
    slice_parts = _slice_parts(total or 0, part_bytes)
    if (largest or 0) > slice_parts * part_bytes:
        large = sizes.where(F.col("_size") > slice_parts * part_bytes).select(*group)
        rows = _slices(rows, large, group, order, slice_parts, part_bytes)
    else:
        none = F.lit(None).cast("bigint")
        rows = rows.withColumns({"_slice": F.lit(0)} | {c: none for c in ("_at", "_before", "_all", "_end")})
    return _placed(rows, group, order, part_bytes, trim)


def _placed(rows: DataFrame, group: list[str], order: list[str], part_bytes: int, trim: bool) -> DataFrame:
    """``rows`` whose slices and starts are known, with what :func:`placed_pieces` adds."""
    here = Window.partitionBy(*group, "_slice")
    earlier = here.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # Ordered like ``earlier``, so that one window serves both and texts wait in one buffer.
    whole = here.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def before(size: str, start: str) -> Column:
        return F.coalesce(F.sum(size).over(earlier), F.lit(0)) + F.coalesce(F.col(start), F.lit(0))

    rows = rows.withColumn("_offset", before("_bytes", "_at"))
    if trim:
        rows = rows.withColumns(
            {
                "_head": before("_solid", "_before") == 0,
                "_rest": F.coalesce("_all", F.sum("_solid").over(whole)) - before("_solid", "_before") - F.col("_solid"),
            }
        )
        text = F.col("text")
        text = F.when(F.col("_head"), trim_start(text)).otherwise(text)
        rows = rows.withColumn("text", F.when(F.col("_rest") == 0, trim_end(text)).otherwise(text))

    def number(offset: Column) -> Column:
        return F.floor(offset / F.lit(part_bytes)).cast("bigint")

    end = F.coalesce("_end", F.max("_offset").over(here))
    return rows.withColumn("_last", number(end)).withColumn("part", number(F.col("_offset"))).drop(
        "_at", "_before", "_all", "_end", "_offset", "_head", "_rest", "_bytes", "_solid"
    )


def _concatenated(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """One row for each run of rows that agree in the first ``width`` columns, the last column concatenated.

    Columns between are those of the run's first row. Texts are appended to the one buffer that leaves as
    the next batch, so a batch that came in is not kept.
    """
    runs: list[tuple] = []
    ends: list[int] = []
    out = bytearray()
    kinds: list[pa.Field] = []
    key = None

    def flushed() -> pa.RecordBatch:
        columns = [pa.array(values, field.type) for values, field in zip(zip(*runs), kinds)]
        large = pa.types.is_large_string(kinds[-1].type)
        offsets = np.array([0, *ends], np.int64 if large else np.int32)
        whole = pa.LargeStringArray if large else pa.StringArray
        columns.append(whole.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(out)))
        return pa.RecordBatch.from_arrays(columns, names=[field.name for field in kinds])

    for batch in batches:
        kinds = list(batch.schema)
        text = batch.column(batch.num_columns - 1)
        if not batch.num_rows:
            continue
        _, offsets, data = text.buffers()
        large = pa.types.is_large_string(text.type)
        at = np.frombuffer(offsets, np.int64 if large else np.int32)[text.offset :][: len(text) + 1].tolist()
        data = memoryview(data if data is not None else b"")
        start = at[0]
        for i, row in enumerate(zip(*(column.to_pylist() for column in batch.columns[:-1]))):
            if row[:width] != key:
                if key is not None:
                    out += data[start : at[i]]
                    ends.append(len(out))
                    if len(out) >= FLUSH_BYTES or len(ends) >= FLUSH_ROWS:
                        yield flushed()
                        runs, ends, out = [], [], bytearray()
                        pa.default_memory_pool().release_unused()
                runs.append(row)
                key, start = row[:width], at[i]
        out += data[start : at[-1]]
        del batch, text, offsets, data
    if key is not None:
        ends.append(len(out))
        yield flushed()


def join_parts(placed: DataFrame, group: Sequence[str], order: Sequence[str], count: bool = False) -> DataFrame:
    """Concatenate placed pieces; a group here is one part, bounded by its byte budget.

    The pieces arrive in order, so a task streams them and holds one part, however many it has. An aggregate
    would hold all parts of its task, each several times over. With ``count`` also ``parts``, the number of
    the group's last part and one.
    """
    group = list(group)
    parts = ["parts"] if count else []
    rows = placed.withColumns({"text": F.coalesce("text", F.lit("")), "parts": F.col("_last") + 1})
    # The windows behind ``placed`` leave this order, so it sorts nothing; it says what is relied on.
    rows = rows.sortWithinPartitions(*group, "_slice", *order).select(*group, "_slice", "part", *parts, "text")
    width = len(group) + 2
    joined = rows.mapInArrow(lambda batches: _concatenated(batches, width), rows.schema)
    return joined.select(*group, "part", "text", *parts)


def assemble(
    pieces: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    part_bytes: int = PART_BYTES,
    trim: bool = False,
    written: bool = False,
    count: bool = False,
) -> DataFrame:
    return join_parts(placed_pieces(pieces, group, order, part_bytes, trim, written), group, order, count)


def assemble_versions(
    pieces: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    names: Sequence[str],
    part_bytes: int = PART_BYTES,
    trim: bool = False,
) -> DataFrame:
    """:func:`assemble` of several versions of a text, ``(*group, part, text, version)``.

    The pieces are the same in all versions but for those with an array ``texts``, which has the text of each.
    Parts are those that :func:`assemble` gives each version by itself. Pieces are written and shuffled once: what
    differs travels in arrays, so that all versions read one exchange, each in tasks of its own. Where slices of
    versions begin at different pieces, those between go to both.
    """
    group, order, names = list(group), list(order), list(names)
    every = range(len(names))
    own = F.transform("texts", lambda text: F.coalesce(text, F.lit("")))
    sizes = F.transform(own, lambda text: F.octet_length(text).cast("bigint"))
    solids = F.transform(own, lambda text: (trim_all(text) != "").cast("bigint"))
    rows = write_pieces(pieces, group, order, _texts=own, _sizes=sizes, _solids=solids)
    held = {"_bytes": "_sizes", "_solid": "_solids"}
    rows = rows.withColumnsRenamed({"_bytes": "_same_bytes", "_solid": "_same_solid"})
    rows = rows.withColumns({f"{c}{k}": F.coalesce(F.get(of, F.lit(k)), f"_same{c}") for c, of in held.items() for k in every})
    found = rows.groupBy(*group).agg(*[F.sum(f"_bytes{k}").alias(f"_size{k}") for k in every])
    totals = found.agg(*[f(f"_size{k}") for k in every for f in (F.sum, F.max)]).first()
    starts = ("_at", "_before", "_all", "_end")
    sliced = False
    for k in every:
        total, largest = totals[2 * k] or 0, totals[2 * k + 1] or 0
        slice_parts = _slice_parts(total, part_bytes)
        if largest > slice_parts * part_bytes:
            large = found.where(F.col(f"_size{k}") > slice_parts * part_bytes).select(*group)
            rows = rows.withColumnsRenamed({f"{c}{k}": c for c in held})
            rows = _slices(rows, large, group, order, slice_parts, part_bytes)
            rows = rows.withColumnsRenamed({c: f"{c}{k}" for c in (*held, "_slice", *starts)})
            sliced = True
        else:
            none = F.lit(None).cast("bigint")
            rows = rows.withColumns({f"_slice{k}": F.lit(0)} | {f"{c}{k}": none for c in starts})
    # One array for each, of which no version's plan can leave out the others' part.
    packed = {c: F.array(*[F.col(f"{c}{k}") for k in every]) for c in ("_slice", *held, *(starts if sliced else ()))}
    rows = rows.select(*group, *order, "text", "_texts", *[array.alias(f"{c}_of") for c, array in packed.items()])
    if sliced:
        rows = rows.withColumn("_slice", F.explode(F.array_distinct("_slice_of"))).repartition(*group, "_slice")
    else:
        rows = rows.repartition(*group).withColumn("_slice", F.lit(0))
    joined = []
    for k, name in enumerate(names):
        mine = F.get("_slice_of", F.lit(k)) == F.col("_slice")
        counted = {c: F.when(mine, F.get(f"{c}_of", F.lit(k))).otherwise(F.lit(0)) for c in held}
        begun = {c: F.get(f"{c}_of", F.lit(k)) if sliced else F.lit(None).cast("bigint") for c in starts}
        version = rows.select(
            *group,
            *order,
            "_slice",
            mine.alias("_mine"),
            F.coalesce(F.get("_texts", F.lit(k)), "text").alias("text"),
            *[column.alias(c) for c, column in (counted | begun).items()],
        )
        # Left out behind the windows only: before them it would be done before the exchange, which is for all.
        placed = _placed(version, group, order, part_bytes, trim).where("_mine")
        joined.append(join_parts(placed, group, order).withColumn("version", F.lit(name)))
    return reduce(DataFrame.unionByName, joined)
