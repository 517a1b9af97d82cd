"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_prompts(prompts: DataFrame, path: str) -> None:
    """Write ``(repo, part, prompt)`` as text files, one folder per repository and part.

    Rows spread over tasks by their own key: a part is a bounded string, so no folder
    makes a task large.
    """
    (
        prompts.select("repo", "part", F.col("prompt").alias("value"))
        .write.mode("errorifexists")
        .partitionBy("repo", "part")
        .text(path)
    )


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """The prompts back, without the newline the text format puts at the end."""
    schema = "value string, repo string, part bigint"
    rows = spark.read.schema(schema).text(path, wholetext=True)
    ended = F.when(F.col("value").endswith("\n"), F.substring("value", F.lit(1), F.length("value") - 1))
    return rows.select("repo", "part", F.coalesce(ended, "value").alias("prompt"))
