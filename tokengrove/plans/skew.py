"""Joins of many rows to few keys where one key may hold a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: A salted group of a key that holds a third of the rows has about this many bytes.
GROUP_BYTES = 64 << 20


def _estimate(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def salt_count(rows: DataFrame, dim: DataFrame) -> int:
    """Salts by the estimated size of ``rows``, where one key may hold a third.

    No more than shuffle partitions, which is all that can run side by side, and no more than
    keep the repeated ``dim`` below the size of ``rows``.
    """
    size = _estimate(rows)
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, min(width, size // 3 // GROUP_BYTES + 1, size // max(1, _estimate(dim))))


def broadcasts(dim: DataFrame) -> bool:
    """Does Spark broadcast ``dim`` by its own threshold? Such a join has no groups."""
    conf = dim.sparkSession._jsparkSession.sessionState().conf()
    return _estimate(dim) <= conf.autoBroadcastJoinThreshold()


def salted_join(
    rows: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str,
    spread: Sequence[str],
    salts: int | None = None,
) -> DataFrame:
    """``rows.join(dim, on, how)`` with every key of ``rows`` split over ``salts`` groups.

    ``spread`` names columns of ``rows`` that vary within a key. ``dim`` is repeated
    once per salt, so it should be the side with few rows. Where Spark broadcasts it
    anyway, nothing is salted or repeated; beyond its threshold the salted shuffle
    balances, and AQE splits what is still large. Only joins that keep or filter ``rows``
    are allowed.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported salted join type: {how}")
    on = list(on)
    if salts is None and broadcasts(dim):
        return rows.join(dim, on, how)
    salts = salts or salt_count(rows, dim)
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def mark(
    rows: DataFrame, keys: DataFrame, on: Sequence[str], flag: str, spread: Sequence[str]
) -> DataFrame:
    """Add boolean ``flag``: does the row's key occur in ``keys``?"""
    dim = keys.select(*on).distinct().withColumn("_hit", F.lit(True))
    return (
        salted_join(rows, dim, on, "left", spread)
        .withColumn(flag, F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )
