"""Corpora held as tables.

The corpus schema, one row per file:

========== ======= ==================================================
repo       STRING  repository; one hot repository may dominate
path       STRING  absolute path
rel_path   STRING  path below the root; ``(repo, rel_path)`` is unique
ext        STRING  extension or null
size       BIGINT  bytes of content
mtime_us   BIGINT  modification time, microseconds
content    STRING  the text
tokens     BIGINT  token count of the content
========== ======= ==================================================
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tokengrove.functions.paths import extension_of
from tokengrove.functions.tokens import tokens_bytes4


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def corpus_view(table: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Project any table onto the corpus schema.

    ``columns`` must give ``repo``, ``rel_path`` and ``content``; what else the
    schema needs and it leaves out is derived. Being a projection, it costs a
    query only the columns that query reads.
    """
    missing = {"repo", "rel_path", "content"} - set(columns)
    if missing:
        raise ValueError(f"corpus view lacks {sorted(missing)}")
    base = table.select(*[c.alias(n) for n, c in columns.items()])
    derived = {
        "path": F.concat(F.lit("/corpus/"), F.col("repo"), F.lit("/"), F.col("rel_path")),
        "ext": extension_of(F.col("rel_path")),
        "size": F.octet_length("content").cast("bigint"),
        "mtime_us": F.lit(None).cast("bigint"),
    }
    for name, expr in derived.items():
        if name not in columns:
            base = base.withColumn(name, expr)
    if "tokens" not in columns:
        base = base.withColumn("tokens", tokens_bytes4(F.col("size")))
    return base.select(
        "repo", "path", "rel_path", "ext", "size", "mtime_us", "content", "tokens"
    )


def documents_corpus(
    spark: SparkSession, folder: str, documents: DataFrame | None = None
) -> DataFrame:
    """The ``documents`` table seen as files of the repositories named by ``source``.

    ``documents`` replaces the table, for instance by a stream of its rows.
    """
    doc = F.col("doc_id")
    ext = F.element_at(
        F.array(*[F.lit(e) for e in ("rs", "py", "md", "TOML", "txt", None)]),
        (doc % 6 + 1).cast("int"),
    )
    rel_path = F.concat(
        F.when(doc % 11 == 0, ".cfg/").otherwise(""),
        F.col("lang"),
        F.lit("/m"),
        (doc % 7).cast("string"),
        F.lit("/"),
        F.when(doc % 3 == 0, "sub/").otherwise(""),
        F.lit("d"),
        doc.cast("string"),
        F.coalesce(F.concat(F.lit("."), ext), F.lit("")),
    )
    return corpus_view(
        read_table(spark, folder, "documents") if documents is None else documents,
        {
            "repo": F.col("source"),
            "rel_path": rel_path,
            "content": F.col("text"),
            "ext": ext,
            "mtime_us": (F.lit(1704067200) + (doc * 7919) % 100000) * 1000000,
        },
    )


def pages_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The ``pages`` table: host is the repository, URL path the file.

    Several URLs may share a path, so the page id makes the leaf unique.
    """
    bare = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    tail = F.regexp_replace(F.regexp_replace(bare, r"^[^/]*/?", ""), r"/+$", "")
    rel_path = F.concat(
        F.when(tail == "", "").otherwise(F.concat(tail, F.lit("/"))),
        F.lit("p"),
        F.col("page_id").cast("string"),
        F.lit(".html"),
    )
    return corpus_view(
        read_table(spark, folder, "pages"),
        {
            "repo": F.regexp_extract(bare, r"^([^/]*)", 1),
            "rel_path": rel_path,
            "content": F.col("html"),
        },
    )
