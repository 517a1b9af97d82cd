"""Choosing files by extension and path prefix, and what a selection amounts to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tokengrove.functions.paths import ancestors, depth_of, parts_of
from tokengrove.functions.text import ascii_lower
from tokengrove.plans.lineage import cut
from tokengrove.plans.skew import broadcasts, mark, salted_join

FILE_KEY = ("repo", "rel_path")


def _under_any(path: Column, prefixes: Sequence[str]) -> Column:
    folded = ascii_lower(path)
    hit = F.lit(False)
    for prefix in prefixes:
        p = ascii_lower(F.lit(prefix.strip("/")))
        hit = hit | (folded == p) | F.startswith(folded, F.concat(p, F.lit("/")))
    return hit


def select_files(
    df: DataFrame, extensions: Sequence[str] = (), prefixes: Sequence[str] = ()
) -> DataFrame:
    """Keep files whose extension is listed and whose path lies under a listed path.

    Either list may be empty, meaning no restriction. Extensions compare exactly,
    paths component by component without ASCII case.
    """
    out = df
    if extensions:
        out = out.where(F.col("ext").isin(list(extensions)))
    if prefixes:
        out = out.where(_under_any(F.col("rel_path"), prefixes))
    return out


def prefix_hits(files: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Keys ``(repo, rel_path)`` of files at or below a path of ``prefixes(repo, value)``.

    Exploding a path to its ancestors makes this an equi-join. The key of a top-level
    directory is shared by every file below it, hence the salts.
    """
    folded = files.select(*FILE_KEY).withColumn("_path", ascii_lower(F.col("rel_path")))
    climbed = folded.withColumn("_node", F.explode(ancestors(F.col("_path"), root=False)))
    wanted = prefixes.select(
        "repo", ascii_lower(F.regexp_replace("value", r"^/+|/+$", "")).alias("_node")
    ).distinct()
    hits = salted_join(climbed, wanted, ["repo", "_node"], "left_semi", ["rel_path"])
    return hits.select(*FILE_KEY).distinct()


def nearest_mark(rows: DataFrame, marks: DataFrame, value: str, path: str = "rel_path") -> DataFrame:
    """``rows`` with the ``value`` of the deepest row of ``marks(repo, node, value)`` at or above their path.

    Null where none is. ``marks`` has a row per node and is a written table. A path is cut to each depth at
    which marks occur and joined there, so rows are neither multiplied nor moved where Spark
    broadcasts the marks; the root is node ``''``.
    """
    depth = depth_of(F.col("node"))
    depths = sorted((r[0] for r in marks.select(depth.alias("d")).distinct().collect()), reverse=True)
    size = F.size(parts_of(F.col(path)))
    for d in depths:
        here = marks.where(depth == d).select("repo", F.col("node").alias("_node"), F.col(value).alias(f"_at{d}"))
        node = F.when(size >= d, F.substring_index(path, "/", d)) if d else F.lit("")
        rows = salted_join(rows.withColumn("_node", node), here, ["repo", "_node"], "left", [path]).drop("_node")
    found = F.coalesce(*[F.col(f"_at{d}") for d in depths]) if depths else F.lit(None).cast(marks.schema[value].dataType)
    return rows.withColumn(value, found).drop(*[f"_at{d}" for d in depths])


def select_by_table(df: DataFrame, selection: DataFrame) -> DataFrame:
    """:func:`select_files` with each repository's own ``selection(repo, kind, value)``.

    Kind is ``extension`` or ``directory``; a repository without rows of a kind is not
    restricted by it. The selection is written; where Spark broadcasts it, ``df`` is filtered in
    place, else its keys are and contents move once.
    """
    exts = cut(
        selection.where(F.col("kind") == "extension").select("repo", F.col("value").alias("ext")).distinct()
    )
    folder = ascii_lower(F.regexp_replace("value", r"^/+|/+$", ""))
    dirs = cut(
        selection.where(F.col("kind") == "directory")
        .select("repo", folder.alias("node"), F.lit(True).alias("_dir_ok"))
        .distinct()
    )
    small = broadcasts(exts) and broadcasts(dirs)
    rows = df if small else df.select(*FILE_KEY, "ext")
    rows = mark(rows, exts, ["repo"], "_by_ext", ["rel_path"])
    rows = mark(rows, dirs, ["repo"], "_by_dir", ["rel_path"])
    rows = mark(rows, exts, ["repo", "ext"], "_ext_ok", ["rel_path"])
    rows = nearest_mark(rows.withColumn("_path", ascii_lower(F.col("rel_path"))), dirs, "_dir_ok", "_path")
    kept = rows.where(
        (~F.col("_by_ext") | F.col("_ext_ok"))
        & (~F.col("_by_dir") | F.coalesce("_dir_ok", F.lit(False)))
    )
    if small:
        return kept.select(*df.columns)
    return df.join(kept.select(*FILE_KEY), list(FILE_KEY), "left_semi")


def flag_by_selection(
    files: DataFrame, selection: DataFrame, active_exts: DataFrame | None = None, default: bool = False
) -> DataFrame:
    """``files`` with ``selected`` and ``active`` from a saved selection, as the roll-ups take them.

    ``selection(repo, path, selected)`` may nest: the nearest row at or above a file decides, ``default``
    where there is none; ``''`` is the root. Rows that name a path twice select it only if all do. A file is active
    if its extension is in ``active_exts(repo, ext)``; left out, all are.
    """
    node = F.regexp_replace("path", r"^/+|/+$", "")
    marks = cut(
        selection.where(F.col("selected").isNotNull())
        .groupBy("repo", node.alias("node"))
        .agg(F.bool_and("selected").alias("selected"))
    )
    flagged = nearest_mark(files.drop("selected", "active"), marks, "selected").withColumn(
        "selected", F.coalesce("selected", F.lit(default))
    )
    if active_exts is None:
        return flagged.withColumn("active", F.lit(True))
    return mark(flagged, active_exts, ["repo", "ext"], "active", ["rel_path"])


def prefix_cover(selection: DataFrame, path: str = "rel_path") -> DataFrame:
    """The selected paths that have no selected proper ancestor, per repository."""
    paths = selection.select("repo", path).distinct()
    climbed = paths.withColumn("_up", F.explode(ancestors(F.col(path), root=True, itself=False)))
    nodes = paths.select("repo", F.col(path).alias("_up"))
    covered = (
        salted_join(climbed, nodes, ["repo", "_up"], "left_semi", [path])
        .select("repo", path)
        .distinct()
    )
    return paths.join(covered, ["repo", path], "left_anti")


def search_extensions(exts: DataFrame, pattern: str) -> DataFrame:
    """Rows whose ``ext`` contains ``pattern`` without ASCII case; empty keeps all."""
    return exts.where(ascii_lower(F.col("ext")).contains(ascii_lower(F.lit(pattern))))


def selection_counters(files: DataFrame, selected: str = "selected") -> DataFrame:
    """Selected and total files and extensions per repository."""
    ext = F.col("ext")
    per_ext = files.groupBy("repo", "ext").agg(
        F.count(F.lit(1)).alias("_files"), F.count_if(F.col(selected)).alias("_chosen")
    )
    return per_ext.groupBy("repo").agg(
        F.sum("_chosen").alias("selected_files"),
        F.sum("_files").alias("total_files"),
        F.count_if(ext.isNotNull() & (F.col("_chosen") > 0)).alias("selected_exts"),
        F.count_if(ext.isNotNull()).alias("total_exts"),
    )
