"""Positions and running sums inside groups of any size.

A window over a whole group would put a hot repository into one task. Instead rows
are range-partitioned on ``(group, order)``; each range slice is numbered on its own
and shifted by the totals of the slices before it, of which there are at most as
many as partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tokengrove.plans.lineage import cut


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add, per group, the sum of each expression over the rows strictly before in ``order``.

    ``sums`` maps a new column to the BIGINT expression summed. ``totals`` maps a new
    column to a name in ``sums`` whose whole-group sum it receives. ``order`` must be
    total within a group. Pass only the columns needed: the rows are written
    out once, which pins the slice a row was put in.
    """
    totals = totals or {}
    group_cols = [F.col(g) for g in group]
    for name, expr in sums.items():
        df = df.withColumn(f"_v_{name}", expr.cast("bigint"))
    placed = cut(
        df.repartitionByRange(*group_cols, *order).withColumn("_slice", F.spark_partition_id())
    )
    per_slice = placed.groupBy(*group, "_slice").agg(
        *[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in sums]
    )
    earlier = (
        Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*group)
    starts = per_slice.select(
        *group,
        "_slice",
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *[F.sum(f"_s_{src}").over(whole).alias(col) for col, src in totals.items()],
    )
    inside = (
        Window.partitionBy("_slice", *group)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = placed.select(
        *[c for c in placed.columns if not c.startswith("_v_")],
        *[F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(f"_i_{n}") for n in sums],
    )
    joined = numbered.join(starts, [*group, "_slice"])
    for name in sums:
        joined = joined.withColumn(name, F.col(f"_b_{name}") + F.col(f"_i_{name}"))
    return joined.drop("_slice", *[f"_{k}_{n}" for k in "bi" for n in sums])


def ranked(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], rank: str = "rank"
) -> DataFrame:
    """Add the 1-based position of each row within its group."""
    out = running(df, group, order, {rank: F.lit(1)})
    return out.withColumn(rank, F.col(rank) + 1)
