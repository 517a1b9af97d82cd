"""Token counts for people, in integer arithmetic throughout."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# n in 1000..9999 lies halfway between two tenths of a thousand when n % 100 == 50. The
# rounding then follows the binary value of n / 1000: these are the n rounded up.
_TIES_UP = tuple(
    n for n in range(1050, 10000, 100) if f"{n / 1000:.1f}" != f"{n // 100 / 10:.1f}"
)


def _div(n: Column, by: int) -> Column:
    return ((n - n % by) / by).cast("bigint")


def fmt_compact(n: Column) -> Column:
    """``999``, ``3.2k``, ``11k``; a thousand thousands stays ``1000k``."""
    tenths = _div(n, 100) + F.when((n % 100 > 50) | n.isin(*_TIES_UP), 1).otherwise(0)
    rest = n % 1000
    whole = _div(n, 1000)
    up = (rest > 500) | ((rest == 500) & (whole % 2 == 1))
    return (
        F.when(n < 1000, n.cast("string"))
        .when(
            n < 10000,
            F.concat(_div(tenths, 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("k")),
        )
        .otherwise(F.concat((whole + F.when(up, 1).otherwise(0)).cast("string"), F.lit("k")))
    )


def fmt_map(n: Column) -> Column:
    """``999``, ``2K``, ``3M``, halves up; 999,500 is ``1000K``."""
    return (
        F.when(n >= 1_000_000, F.concat(_div(n + 500_000, 1_000_000).cast("string"), F.lit("M")))
        .when(n >= 1_000, F.concat(_div(n + 500, 1_000).cast("string"), F.lit("K")))
        .otherwise(n.cast("string"))
    )
