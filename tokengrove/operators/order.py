"""File orders. Each is a global range sort; ranks come from range slices, not from one task per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tokengrove.functions.paths import parts_of
from tokengrove.plans.slices import ranked

METHODS = ("name-asc", "name-desc", "date-asc", "date-desc")


def sort_key(method: str) -> list[Column]:
    """Names compare component by component; a missing date is the earliest; ties go by name."""
    name = parts_of(F.col("rel_path"))
    date = F.col("mtime_us")
    if method == "name-asc":
        return [name.asc()]
    if method == "name-desc":
        return [name.desc()]
    if method == "date-asc":
        return [date.asc_nulls_first(), name.asc()]
    if method == "date-desc":
        return [date.desc_nulls_last(), name.asc()]
    raise ValueError(f"sort method {method!r} is none of {METHODS}")


def sort_files(files: DataFrame, method: str = "name-asc") -> DataFrame:
    return files.orderBy("repo", *sort_key(method))


def rank_files(files: DataFrame, method: str = "name-asc", rank: str = "rank") -> DataFrame:
    """Add each file's position in its repository."""
    return ranked(files, ["repo"], sort_key(method), rank)
