"""Row filters on a corpus. All are single expressions that Catalyst can push to the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
import pandas as pd
from pyspark.sql.types import StringType

from tokengrove.functions.globs import DEFAULT_EXCLUDES, glob_to_regex, matches_globs
from tokengrove.functions.paths import is_hidden
from tokengrove.plans.skew import salted_join

MAX_FILE_BYTES = 1_048_576  # fixed value: larger files are left out, exactly this size is kept


def size_guard(df: DataFrame, size: str = "size") -> DataFrame:
    """Drop empty files and files above :data:`MAX_FILE_BYTES`, judged on the size column."""
    return df.where(F.col(size).between(1, MAX_FILE_BYTES))


def utf8_guard(df: DataFrame, content: str = "content") -> DataFrame:
    """Drop rows whose BINARY content is not UTF-8; cast the rest to string. Nothing is replaced."""
    text = F.col(content).cast("string")
    return df.where(F.is_valid_utf8(text)).withColumn(content, text)


def drop_hidden(df: DataFrame, hidden: bool = False, path: str = "rel_path") -> DataFrame:
    return df if hidden else df.where(~is_hidden(F.col(path)))


def drop_symlinks(df: DataFrame, follow: bool = False) -> DataFrame:
    return df if follow else df.where(~F.col("is_symlink"))


def include_patterns(include: Sequence[str] = (), extensions: Sequence[str] = ()) -> list[str]:
    """Include globs plus one ``**/*.ext`` per extension."""
    return [*include, *(f"**/*.{e}" for e in extensions)]


def exclude_patterns(
    config: Sequence[str] = (), exclude: Sequence[str] = (), defaults: bool = True
) -> list[str]:
    return [*config, *exclude, *(DEFAULT_EXCLUDES if defaults else ())]


def glob_decision(
    path: Column,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    include_priority: bool = False,
) -> Column:
    """Is the path kept? Exclusion is only tested on included paths; priority overrules it."""
    included = matches_globs(path, include) if include else F.lit(True)
    if not exclude or include_priority:
        return included
    return included & ~matches_globs(path, exclude)


def filter_globs(
    df: DataFrame,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    include_priority: bool = False,
    path: str = "rel_path",
) -> DataFrame:
    return df.where(glob_decision(F.col(path), include, exclude, include_priority))


@F.pandas_udf(StringType())
def _compiled(globs: pd.Series) -> pd.Series:
    return globs.map(glob_to_regex)


def filter_glob_table(
    df: DataFrame, globs: DataFrame, include_priority: bool = False, path: str = "rel_path"
) -> DataFrame:
    """The same decision with each repository's own globs: ``globs(repo, kind, glob)``.

    Kind is ``include`` or ``exclude``. The globs of a repository fuse into one regex
    per kind, so each file meets one row; a repository without globs keeps everything.
    """
    fused = F.concat(
        F.lit(r"(?s)\A(?:"),
        F.array_join(F.array_sort(F.collect_set(_regex_of("include"))), "|"),
        F.lit(r")\z"),
    )
    regexes = (
        globs.select("repo", "kind", _compiled("glob").alias("regex"))
        .groupBy("repo")
        .agg(
            F.max(F.when(F.col("kind") == "include", True)).alias("_has_inc"),
            F.max(F.when(F.col("kind") == "exclude", True)).alias("_has_exc"),
            fused.alias("_inc"),
            F.concat(
                F.lit(r"(?s)\A(?:"),
                F.array_join(F.array_sort(F.collect_set(_regex_of("exclude"))), "|"),
                F.lit(r")\z"),
            ).alias("_exc"),
        )
    )
    joined = salted_join(df, regexes, ["repo"], "left", [path])
    included = F.col("_has_inc").isNull() | F.rlike(F.col(path), F.col("_inc"))
    excluded = F.col("_has_exc").isNotNull() & F.rlike(F.col(path), F.col("_exc"))
    keep = included if include_priority else included & ~excluded
    return joined.where(keep).drop("_has_inc", "_has_exc", "_inc", "_exc")


def _regex_of(kind: str) -> Column:
    return F.when(F.col("kind") == kind, F.col("regex"))
