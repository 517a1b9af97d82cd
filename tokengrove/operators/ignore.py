"""Hierarchical ignore files.

The last matching rule of the deepest ignore file decides about a node; whatever lies
below an ignored directory is ignored too, and no deeper rule can bring it back.
"""

from __future__ import annotations

from collections.abc import Iterator
import json

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tokengrove.functions.globs import RuleSet, ignore_line_to_rule
from tokengrove.functions.paths import ancestors, depth_of, name_of, parent_of
from tokengrove.operators.rollup import distinct_dirs
from tokengrove.plans.lineage import cut
from tokengrove.plans.skew import salted_join

#: Rules of all distinct ignore files that are sent to every task; compiled sets that a task keeps.
RULE_BYTES, COMPILED_SETS = 16 << 20, 10_000

RULES_SCHEMA = "repo string, base_dir string, line_no int, regex string, negated boolean, dir_only boolean"


def read_rules(files: DataFrame, file_name: str = ".gitignore") -> DataFrame:
    """Rules from the ignore files among ``files(repo, rel_path, content)``."""
    lines = files.where(name_of(F.col("rel_path")) == file_name).select(
        "repo",
        parent_of(F.col("rel_path")).alias("base_dir"),
        F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line"),
    )

    def compiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rules = batch["line"].map(ignore_line_to_rule)
            batch = batch[rules.notna()]
            parts = pd.DataFrame(
                rules.dropna().tolist(),
                columns=["regex", "negated", "dir_only"],
                index=batch.index,
            )
            yield batch[["repo", "base_dir", "line_no"]].join(parts)

    return lines.mapInPandas(compiled, RULES_SCHEMA)


def _rule_sets(rules: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, str] | None]:
    """Where each ignore file lies, ``(repo, base_dir, set)``, and the rules of each distinct set as JSON,
    also as a dictionary if they have at most ``RULE_BYTES``."""
    order = F.array_sort(F.collect_list(F.struct("line_no", "regex", "negated", "dir_only")))
    listed = rules.groupBy("repo", "base_dir").agg(order.alias("_rules"))
    bare = F.transform("_rules", lambda r: F.struct(r["regex"], r["negated"], r["dir_only"]))
    text = F.to_json(bare)
    listed = cut(listed.select("repo", "base_dir", text.alias("_text"), F.sha2(text, 256).alias("_set")))
    sets = cut(listed.select("_set", "_text").distinct())
    size = sets.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    known = {r["_set"]: r["_text"] for r in sets.collect()} if size <= RULE_BYTES else None
    return listed.select("repo", "base_dir", "_set"), sets, known


def node_verdicts(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Nodes ``(repo, node)`` some rule matches, with ``ignored`` by the deciding rule.

    ``nodes`` has ``(repo, node, is_dir)``.
    """
    return _verdicts(nodes, *_rule_sets(rules))


def _verdicts(nodes: DataFrame, places: DataFrame, sets: DataFrame, known: dict[str, str] | None) -> DataFrame:
    """:func:`node_verdicts` by sets of rules.

    A node meets the digest of each ignore file above it. The rules of a digest are compiled once in
    a task; equal files share one. They are sent to all tasks if ``known``, else they join on the digest.
    """
    climbed = nodes.withColumn(
        "base_dir", F.explode(ancestors(F.col("node"), root=True, itself=False))
    )
    met = salted_join(climbed, places, ["repo", "base_dir"], "inner", ["node"])
    below = F.when(F.col("base_dir") == "", F.col("node")).otherwise(
        F.substring(F.col("node"), F.length("base_dir") + 2, F.length("node"))
    )
    if known is not None:
        met = met.withColumn("_text", F.lit(None).cast("string"))
    else:
        met = salted_join(met, sets, ["_set"], "inner", ["repo", "node"])
    shipped = nodes.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("boolean")
    def verdict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        compiled: dict[str, RuleSet] = {}
        for sets, texts, paths, dirs in batches:
            out = []
            for name, text, path, is_dir in zip(sets, texts, paths, dirs):
                rules = compiled.get(name)
                if rules is None:
                    if len(compiled) >= COMPILED_SETS:
                        compiled.clear()
                    listed = json.loads(text or shipped.value[name])
                    rules = compiled[name] = RuleSet((r["regex"], r["negated"], r["dir_only"]) for r in listed)
                out.append(rules.ignored(path, is_dir))
            yield pd.Series(out, dtype=object)

    decided = met.withColumn("_ignored", verdict("_set", "_text", below, "is_dir")).where(
        F.col("_ignored").isNotNull()
    )
    return decided.groupBy("repo", "node", "is_dir").agg(
        F.max_by("_ignored", depth_of(F.col("base_dir"))).alias("ignored")
    )


def drop_ignored(files: DataFrame, rules: DataFrame, no_ignore: bool = False) -> DataFrame:
    """Files that neither themselves nor through an ancestor directory are ignored.

    Directories are judged once each, not once per file below them. What is ignored is written
    and leaves ``files`` where they are, as long as Spark can broadcast it.
    """
    if no_ignore:
        return files
    dirs = cut(distinct_dirs(files))
    found = _rule_sets(rules)
    bad_dirs = cut(
        _verdicts(dirs.select("repo", F.col("dir").alias("node"), F.lit(True).alias("is_dir")), *found)
        .where("ignored")
        .select("repo", F.col("node").alias("_up"))
    )
    climbed = dirs.withColumn("_up", F.explode(ancestors(F.col("dir"), root=False)))
    blocked = cut(
        salted_join(climbed, bad_dirs, ["repo", "_up"], "left_semi", ["dir"])
        .select("repo", F.col("dir").alias("_parent"))
        .distinct()
    )

    def outside(rows: DataFrame) -> DataFrame:
        inside = rows.withColumn("_parent", parent_of(F.col("rel_path")))
        return salted_join(inside, blocked, ["repo", "_parent"], "left_anti", ["rel_path"]).drop("_parent")

    leaves = outside(files.select("repo", "rel_path"))
    bad_files = cut(
        _verdicts(leaves.select("repo", F.col("rel_path").alias("node"), F.lit(False).alias("is_dir")), *found)
        .where("ignored")
        .select("repo", F.col("node").alias("rel_path"))
    )
    return outside(files).join(bad_files, ["repo", "rel_path"], "left_anti")
