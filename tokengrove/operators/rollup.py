"""Counts and sums per extension and per directory.

A file's numbers reach its ancestors by exploding *directories*, after one
pre-aggregation per directory: rows multiply by depth only once they are few, and the
root of a hot repository is a partial aggregate in every task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tokengrove.functions.paths import ancestors, depth_of, name_of, parent_of
from tokengrove.functions.text import ascii_lower
from tokengrove.plans.skew import mark


def ext_counts(files: DataFrame) -> DataFrame:
    """Files per ASCII-lowercased extension; files without one are not counted."""
    return (
        files.where(F.col("ext").isNotNull())
        .groupBy("repo", ascii_lower(F.col("ext")).alias("ext"))
        .agg(F.count(F.lit(1)).alias("files"))
    )


def dir_counts(files: DataFrame) -> DataFrame:
    """Files per direct parent directory; files at the root are not counted."""
    return (
        files.select("repo", parent_of(F.col("rel_path")).alias("dir"))
        .where("dir <> ''")
        .groupBy("repo", "dir")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def ext_tokens(files: DataFrame) -> DataFrame:
    """Token sum per extension, case kept; rows lacking either are skipped."""
    return (
        files.where(F.col("ext").isNotNull() & F.col("tokens").isNotNull())
        .groupBy("repo", "ext")
        .agg(F.sum("tokens").alias("tokens"))
    )


def token_total(files: DataFrame) -> DataFrame:
    return files.groupBy("repo").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def corpus_summary(files: DataFrame) -> DataFrame:
    """Label and number of files of each repository."""
    return files.groupBy(F.col("repo").alias("label")).agg(F.count(F.lit(1)).alias("files"))


def distinct_dirs(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Every directory ``(repo, dir)`` on the way to a file, the root excluded."""
    direct = files.select("repo", parent_of(F.col(path)).alias("dir")).distinct()
    return direct.select(
        "repo", F.explode(ancestors(F.col("dir"), root=False)).alias("dir")
    ).where("dir <> ''").distinct()


def _shape(nodes: DataFrame, *values: str) -> DataFrame:
    node = F.col("node")
    return nodes.select(
        "repo",
        "node",
        F.when(node == "", F.lit(None)).otherwise(parent_of(node)).alias("parent"),
        name_of(node).alias("name"),
        depth_of(node).cast("int").alias("depth"),
        "is_dir",
        *values,
    )


def dir_rollup(
    df: DataFrame,
    path: str = "rel_path",
    files: str | None = None,
    ext: str = "ext",
    tokens: str = "tokens",
) -> DataFrame:
    """All tree nodes with the files and tokens at or below them; the root is ``''``.

    Column names are arguments, so any DataFrame with a ``repo`` and a path rolls up.
    ``files`` names a column of file counts; left out, each row is one file.
    """
    one = F.lit(1).cast("bigint") if files is None else F.col(files).cast("bigint")
    leaf = df.select(
        "repo",
        F.col(path).alias("node"),
        one.alias("files"),
        F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("tokens"),
    )
    per_dir = leaf.groupBy("repo", parent_of(F.col("node")).alias("dir")).agg(
        F.sum("files").alias("files"), F.sum("tokens").alias("tokens")
    )
    dirs = (
        per_dir.select(
            "repo", F.explode(ancestors(F.col("dir"))).alias("node"), "files", "tokens"
        )
        .groupBy("repo", "node")
        .agg(F.sum("files").alias("files"), F.sum("tokens").alias("tokens"))
    )
    nodes = dirs.withColumn("is_dir", F.lit(True)).unionByName(
        leaf.withColumn("is_dir", F.lit(False))
    )
    return _shape(nodes, "files", "tokens")


def node_tokens(files: DataFrame) -> DataFrame:
    """Token sum per tree node, over files that have tokens."""
    return dir_rollup(files.where(F.col("tokens") > 0)).drop("files")


def visible_totals(files: DataFrame, selected: str = "selected", active: str = "active") -> DataFrame:
    """Per node, files and tokens of the files that are selected and whose extension is active.

    ``selected`` and ``active`` are boolean columns of ``files``; nodes left with nothing show 0.
    """
    seen = F.col(selected) & F.col(active)
    counted = files.select(
        "repo",
        "rel_path",
        "ext",
        F.when(seen, 1).otherwise(0).cast("bigint").alias("_seen"),
        F.when(seen, F.coalesce("tokens", F.lit(0))).otherwise(0).alias("tokens"),
    )
    return dir_rollup(counted, files="_seen").select(
        "repo",
        "node",
        "is_dir",
        F.col("files").alias("visible_files"),
        F.col("tokens").alias("visible_tokens"),
    )


def visible_ext_totals(
    files: DataFrame, selected: str = "selected", active: str = "active"
) -> DataFrame:
    """The same sum per extension, zeros kept."""
    seen = F.col(selected) & F.col(active)
    return (
        files.where(F.col("ext").isNotNull())
        .groupBy("repo", "ext")
        .agg(F.coalesce(F.sum(F.when(seen, F.col("tokens"))), F.lit(0)).alias("visible_tokens"))
    )


def selection_state(files: DataFrame, selected: str = "selected") -> DataFrame:
    """Per directory: is everything below it selected, or only a part?"""
    per_dir = files.groupBy("repo", parent_of(F.col("rel_path")).alias("dir")).agg(
        F.bool_and(selected).alias("_all"), F.bool_or(selected).alias("_any")
    )
    return (
        per_dir.select("repo", F.explode(ancestors(F.col("dir"))).alias("node"), "_all", "_any")
        .groupBy("repo", "node")
        .agg(F.bool_and("_all").alias("selected"), F.bool_or("_any").alias("_some"))
        .select("repo", "node", "selected", (F.col("_some") & ~F.col("selected")).alias("partial"))
    )


def allowed_nodes(files: DataFrame, active_exts: DataFrame) -> DataFrame:
    """Nodes with a file below (or being one) whose extension is in ``active_exts(repo, ext)``."""
    flagged = mark(
        files.select("repo", "rel_path", "ext"), active_exts, ["repo", "ext"], "_on", ["rel_path"]
    )
    active = flagged.where("_on").select("repo", "rel_path")
    dirs = active.select("repo", parent_of(F.col("rel_path")).alias("dir")).distinct()
    return (
        dirs.select("repo", F.explode(ancestors(F.col("dir"))).alias("node"))
        .distinct()
        .unionByName(active.select("repo", F.col("rel_path").alias("node")))
    )
