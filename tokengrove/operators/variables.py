"""Template variables from several sources, and what a template still lacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Names every prompt provides itself.
RESERVED = (
    "path",
    "code",
    "git_diff",
    "source_tree",
    "absolute_code_path",
    "files",
    "git_diff_branch",
    "git_log_branch",
)

# First wins. The other order some users expect can be passed instead.
PRIORITY = ("cli", "file", "cached", "config", "env")
DOCUMENTED_PRIORITY = ("cli", "env", "file", "config", "cached")


def merge_vars(variables: DataFrame, order: Sequence[str] = PRIORITY) -> DataFrame:
    """One value per ``(repo, key)`` of ``variables(repo, source, key, value)``.

    The source first in ``order`` wins, the smallest value should one source repeat a
    key. An aggregate, so a key shared by many rows is reduced before the shuffle.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    ranked = variables.where(rank > 0)
    return ranked.groupBy("repo", "key").agg(
        F.min(F.struct(rank.alias("rank"), F.col("value"), F.col("source"))).alias("_best")
    ).select("repo", "key", "_best.value", "_best.source")


def placeholder_names(template: Column) -> Column:
    """Plain ``{{name}}`` outside blocks, reserved names left out; an array with repetitions."""
    tags = F.transform(
        F.regexp_extract_all(template, F.lit(r"\{\{\{?[^{}]*\}\}\}?"), F.lit(0)),
        lambda t: F.regexp_replace(t, r"^\{+\s*|\s*\}+$", ""),
    )
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, tag: Column) -> Column:
        plain = (
            (acc["depth"] == 0)
            & tag.rlike(r"^[A-Za-z_][A-Za-z0-9_-]*$")
            & ~tag.isin(*RESERVED)
        )
        return F.struct(
            F.when(tag.startswith("#"), acc["depth"] + 1)
            .when(tag.startswith("/"), acc["depth"] - 1)
            .otherwise(acc["depth"])
            .alias("depth"),
            F.when(plain, F.concat(acc["names"], F.array(tag))).otherwise(acc["names"]).alias("names"),
        )

    return F.aggregate(tags, start, step, lambda acc: acc["names"])


def placeholders(templates: DataFrame) -> DataFrame:
    """Distinct ``(repo, key)`` the templates of ``templates(repo, body)`` ask for."""
    return templates.select(
        "repo", F.explode(placeholder_names(F.col("body"))).alias("key")
    ).distinct()


def missing_vars(templates: DataFrame, variables: DataFrame) -> DataFrame:
    """Placeholders without a value."""
    return placeholders(templates).join(
        variables.select("repo", "key").distinct(), ["repo", "key"], "left_anti"
    )
