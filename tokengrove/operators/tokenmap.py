"""The token map: the directories and files of a repository that cost the most."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tokengrove.functions.paths import ancestors, name_of
from tokengrove.operators.rollup import node_tokens

MAX_LINES = 20  # fixed value
MIN_PERCENT = 0.1  # fixed value
OTHER_FILES = "(other files)"  # fixed value


def _shown(files: DataFrame, max_lines: int, min_percent: float) -> DataFrame:
    """The nodes to show and the root of each repository, with its ``total``.

    A best-first search from the root takes nodes in the order tokens descending,
    depth ascending, path descending: a parent never has fewer tokens than its child
    and is shallower, so the order alone decides and a rank replaces the search. The
    threshold spares directories, so files and directories are cut to the top ranks
    separately; Spark limits both before the shuffle (``WindowGroupLimit``), and all
    later windows see at most twice ``max_lines`` rows per repository.
    """
    order = [F.col("tokens").desc(), F.col("depth").asc(), F.col("node").desc()]
    top = Window.partitionBy("repo", "is_dir").orderBy(*order)
    short = (
        node_tokens(files)
        .withColumn("_rank", F.row_number().over(top))
        .where(F.col("_rank") <= max(max_lines, 1))
        .drop("_rank")
    )
    repo = Window.partitionBy("repo")
    total = F.max(F.when(F.col("depth") == 0, F.col("tokens"))).over(repo)
    threshold = F.ceil(F.col("total").cast("double") * F.lit(float(min_percent)) / F.lit(100.0))
    eligible = F.col("is_dir") | (F.col("tokens") >= threshold)
    best = Window.partitionBy("repo").orderBy((F.col("depth") == 0).desc(), *order)
    return (
        short.withColumn("total", total)
        .where(eligible)
        .withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") <= max(max_lines, 1))
        .drop("_rank")
    )


def token_map_nodes(
    files: DataFrame, max_lines: int = MAX_LINES, min_percent: float = MIN_PERCENT
) -> DataFrame:
    """The at most ``max_lines - 1`` nodes a token map shows."""
    return (
        _shown(files, max_lines, min_percent)
        .where("depth > 0")
        .select("repo", "node", "is_dir", "depth", "tokens")
    )


def token_map(
    files: DataFrame, max_lines: int = MAX_LINES, min_percent: float = MIN_PERCENT
) -> DataFrame:
    """The report in preorder, siblings by tokens descending, then name; ``line`` numbers it.

    What the shown files leave is one last row, built from the root's row.
    """
    repo = Window.partitionBy("repo")
    shown = _shown(files, max_lines, min_percent)
    with_repo = shown.withColumn(
        "_tokens_of", F.map_from_entries(F.collect_list(F.struct("node", "tokens")).over(repo))
    ).withColumn(
        "_left",
        F.col("total")
        - F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("tokens"))).over(repo), F.lit(0)),
    )
    preorder = F.transform(
        ancestors(F.col("node"), root=False),
        lambda a: F.struct((-F.col("_tokens_of")[a]).alias("t"), name_of(a).alias("n")),
    )
    siblings = Window.partitionBy("repo", "parent").orderBy(F.col("tokens").desc(), F.col("name"))
    is_root = F.col("depth") == 0
    lines = with_repo.where(~is_root | (F.col("_left") > 0)).select(
        "repo",
        F.when(is_root, F.lit(OTHER_FILES)).otherwise(F.col("node")).alias("path"),
        F.when(is_root, F.lit(OTHER_FILES)).otherwise(F.col("name")).alias("name"),
        F.when(is_root, F.col("_left")).otherwise(F.col("tokens")).alias("tokens"),
        "total",
        "depth",
        F.lead("node").over(siblings).isNull().alias("is_last"),
        (F.col("is_dir") & ~is_root).alias("is_dir"),
        is_root.alias("_other"),
        preorder.alias("_key"),
    )
    in_order = Window.partitionBy("repo").orderBy("_other", "_key")
    return lines.select(
        "repo",
        F.row_number().over(in_order).alias("line"),
        "path",
        "name",
        "tokens",
        F.when(F.col("total") > 0, F.col("tokens").cast("double") / F.col("total") * 100.0)
        .otherwise(0.0)
        .alias("percentage"),
        "depth",
        "is_last",
        "is_dir",
    )


def other_files(
    files: DataFrame, max_lines: int = MAX_LINES, min_percent: float = MIN_PERCENT
) -> DataFrame:
    """Only the remainder: tokens of files the map does not show, where there are any."""
    return (
        _shown(files, max_lines, min_percent)
        .groupBy("repo")
        .agg(
            (
                F.max("total")
                - F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("tokens"))), F.lit(0))
            ).alias("tokens")
        )
        .where("tokens > 0")
    )
