"""What every registered query shares: a name, a Spark callable and, where SQL can say it, a twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The SQL twins have each prompt as one part, whole up to what a cell can hold with room to spare.
WHOLE_BYTES = 1 << 30

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The projection of ``documents_corpus`` in SQL.
CORPUS = """
corpus AS (
  SELECT *, '/corpus/' || repo || '/' || rel_path AS path,
         (size + 3) // 4 AS tokens,
         regexp_replace(rel_path, '/?[^/]*$', '') AS dir,
         string_split(rel_path, '/') AS parts
  FROM (
    SELECT doc_id, source AS repo,
      CASE WHEN doc_id % 11 = 0 THEN '.cfg/' ELSE '' END || lang || '/m' || (doc_id % 7) || '/'
        || CASE WHEN doc_id % 3 = 0 THEN 'sub/' ELSE '' END || 'd' || doc_id
        || COALESCE('.' || ext, '') AS rel_path,
      ext, CAST(strlen(text) AS BIGINT) AS size,
      CAST((1704067200 + (doc_id * 7919) % 100000) * 1000000 AS BIGINT) AS mtime_us,
      text AS content
    FROM (SELECT *, CASE doc_id % 6 WHEN 0 THEN 'rs' WHEN 1 THEN 'py' WHEN 2 THEN 'md'
                 WHEN 3 THEN 'TOML' WHEN 4 THEN 'txt' END AS ext FROM documents)
  )
)"""

# Every ancestor of a file, itself and the root included: (repo, node, leaf, tokens, ...).
CLIMBED = (
    CORPUS
    + """,
climbed AS (
  SELECT repo, rel_path, ext, tokens, len(parts) AS n, i,
         array_to_string(parts[1:i], '/') AS node, i < len(parts) AS is_dir
  FROM corpus, LATERAL (SELECT unnest(range(0, len(parts) + 1)) AS i)
)"""
)


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


def over_corpus(sql: str) -> str:
    return f"WITH {CORPUS}\n{sql}"


def over_climbed(sql: str) -> str:
    return f"WITH {CLIMBED}\n{sql}"
