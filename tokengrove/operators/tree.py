"""Source trees as ordered lines ``(repo, key, text)``.

A tree has a line per file, so it is kept as rows; :mod:`tokengrove.plans.assemble`
joins them where one string is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tokengrove.functions.paths import ancestors, depth_of, name_of, parent_of, parts_of
from tokengrove.operators.rollup import distinct_dirs
from tokengrove.plans.assemble import PART_BYTES, assemble
from tokengrove.plans.skew import salted_join

# The four pieces a row is drawn with.
MIDDLE, LAST, PASS, GAP = "├── ", "└── ", "│   ", "    "


def _root_lines(files: DataFrame, label: Column) -> DataFrame:
    return files.select("repo").distinct().select(
        "repo",
        F.array().cast("array<string>").alias("key"),
        F.concat(label, F.lit("\n")).alias("text"),
    )


def flat_tree(files: DataFrame, label: Column | None = None) -> DataFrame:
    """The root label, then every relative path as a leaf in byte order."""
    last = files.groupBy("repo").agg(F.max("rel_path").alias("rel_path")).withColumn(
        "_last", F.lit(True)
    )
    leaves = files.select("repo", "rel_path").join(last, ["repo", "rel_path"], "left")
    glyph = F.when(F.col("_last"), F.lit(LAST)).otherwise(F.lit(MIDDLE))
    rows = leaves.select(
        "repo",
        F.array("rel_path").alias("key"),
        F.concat(glyph, F.col("rel_path"), F.lit("\n")).alias("text"),
    )
    return _root_lines(files, F.col("repo") if label is None else label).unionByName(rows)


def tree_glyphs(files: DataFrame) -> DataFrame:
    """Each node of the nested tree with the ``glyphs`` before its name.

    The last child of each directory comes from a maximum, not from a window over the
    siblings; the bars above a node are gathered per directory, not per file.
    """
    dirs = distinct_dirs(files)
    nodes = dirs.select("repo", F.col("dir").alias("node"), F.lit(True).alias("is_dir")).unionByName(
        files.select("repo", F.col("rel_path").alias("node"), F.lit(False).alias("is_dir"))
    )
    nodes = nodes.withColumn("parent", parent_of(F.col("node"))).withColumn(
        "name", name_of(F.col("node"))
    )
    youngest = nodes.groupBy("repo", "parent").agg(F.max("name").alias("name"))
    last = youngest.select(
        "repo",
        F.when(F.col("parent") == "", F.col("name"))
        .otherwise(F.concat("parent", F.lit("/"), "name"))
        .alias("node"),
        F.lit(True).alias("_last"),
    )
    climbed = dirs.withColumn("node", F.explode(ancestors(F.col("dir"), root=False)))
    bar = F.when(F.col("_last"), F.lit(GAP)).otherwise(F.lit(PASS))
    bars = (
        salted_join(climbed, last, ["repo", "node"], "left", ["dir"])
        .groupBy("repo", F.col("dir").alias("parent"))
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(
                        F.collect_list(
                            F.struct(depth_of(F.col("node")).alias("d"), bar.alias("bar"))
                        )
                    ),
                    lambda s: s["bar"],
                ),
                "",
            ).alias("_bars")
        )
    )
    flagged = nodes.join(last, ["repo", "node"], "left")
    drawn = salted_join(flagged, bars, ["repo", "parent"], "left", ["node"])
    return drawn.select(
        "repo",
        "node",
        "name",
        "is_dir",
        F.concat(
            F.coalesce("_bars", F.lit("")),
            F.when(F.col("_last"), F.lit(LAST)).otherwise(F.lit(MIDDLE)),
        ).alias("glyphs"),
    )


def full_tree(files: DataFrame, label: Column | None = None) -> DataFrame:
    """The nested tree in component order below the root label."""
    rows = tree_glyphs(files).select(
        "repo",
        parts_of(F.col("node")).alias("key"),
        F.concat("glyphs", "name", F.lit("\n")).alias("text"),
    )
    return _root_lines(files, F.col("repo") if label is None else label).unionByName(rows)


def source_tree(files: DataFrame, full: bool = False, label: Column | None = None) -> DataFrame:
    return full_tree(files, label) if full else flat_tree(files, label)


def tree_text(lines: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The lines of each tree joined: ``(repo, part, text)``."""
    return assemble(lines, ["repo"], ["key"], part_bytes)
