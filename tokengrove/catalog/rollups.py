"""Roll-ups, selection arithmetic and the token map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokengrove.catalog.base import CLIMBED, over_climbed, over_corpus, register
from tokengrove.functions.paths import ancestors, depth_of
from tokengrove.operators import rollup, selection, tokenmap
from tokengrove.plans.slices import ranked
from tokengrove.sources.tables import documents_corpus as corpus, pages_corpus


@register("ext_counts", over_corpus("""
SELECT repo, translate(ext, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS ext,
       count(*) AS files
FROM corpus WHERE ext IS NOT NULL GROUP BY 1, 2"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.ext_counts(corpus(spark, sf))


@register("dir_counts", over_corpus("""
SELECT repo, dir, count(*) AS files FROM corpus WHERE dir <> '' GROUP BY 1, 2"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.dir_counts(corpus(spark, sf))


@register("ext_tokens", over_corpus("""
SELECT repo, ext, CAST(sum(tokens) AS BIGINT) AS tokens,
       row_number() OVER (PARTITION BY repo ORDER BY sum(tokens) DESC, ext) AS rank
FROM corpus WHERE ext IS NOT NULL GROUP BY 1, 2"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(
        rollup.ext_tokens(corpus(spark, sf)), ["repo"], [F.col("tokens").desc(), F.col("ext")]
    )


@register("dir_rollup", over_climbed("""
SELECT repo, node,
       CASE WHEN node <> '' THEN regexp_replace(node, '/?[^/]*$', '') END AS parent,
       regexp_replace(node, '^.*/', '') AS name, CAST(i AS INTEGER) AS depth, is_dir,
       count(*) AS files, CAST(sum(tokens) AS BIGINT) AS tokens
FROM climbed GROUP BY repo, node, i, is_dir"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.dir_rollup(corpus(spark, sf))


_PAGES = """
WITH bare AS (
  SELECT page_id, html, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS b FROM pages
), cut AS (
  SELECT page_id, html, regexp_extract(b, '^([^/]*)', 1) AS repo,
         regexp_replace(regexp_replace(b, '^[^/]*/?', ''), '/+$', '') AS tail FROM bare
), files AS (
  SELECT repo, CASE WHEN tail = '' THEN '' ELSE tail || '/' END || 'p' || page_id || '.html' AS rel_path,
         (CAST(strlen(html) AS BIGINT) + 3) // 4 AS tokens FROM cut
)"""


@register("dir_rollup_pages", _PAGES + """
SELECT repo, array_to_string(string_split(rel_path, '/')[1:i], '/') AS node,
       i < len(string_split(rel_path, '/')) AS is_dir,
       count(*) AS files, CAST(sum(tokens) AS BIGINT) AS tokens
FROM files, LATERAL (SELECT unnest(range(0, len(string_split(rel_path, '/')) + 1)) AS i)
GROUP BY 1, 2, 3""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.dir_rollup(pages_corpus(spark, sf)).select(
        "repo", "node", "is_dir", "files", "tokens"
    )


@register("node_tokens", over_climbed("""
SELECT repo, node, CAST(i AS INTEGER) AS depth, is_dir, CAST(sum(tokens) AS BIGINT) AS tokens
FROM climbed WHERE tokens > 0 GROUP BY repo, node, i, is_dir"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.node_tokens(corpus(spark, sf)).select("repo", "node", "depth", "is_dir", "tokens")


@register("token_total", over_corpus("""
SELECT repo, CAST(sum(tokens) AS BIGINT) AS tokens FROM corpus GROUP BY repo"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.token_total(corpus(spark, sf))


@register("corpus_summary", over_corpus("""
SELECT repo AS label, count(*) AS files FROM corpus GROUP BY repo"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.corpus_summary(corpus(spark, sf))


def _token_map_sql(max_lines: int, min_percent: float, tail: str) -> str:
    return f"""WITH {CLIMBED},
nodes AS (
  SELECT repo, node, i AS depth, is_dir, CAST(sum(tokens) AS BIGINT) AS tokens
  FROM climbed WHERE tokens > 0 AND i > 0 GROUP BY ALL
), totals AS (
  SELECT repo, CAST(sum(tokens) AS BIGINT) AS total FROM corpus GROUP BY repo
), shown AS (
  SELECT * FROM (
    SELECT n.*, total, row_number() OVER (PARTITION BY n.repo
             ORDER BY tokens DESC, depth, node DESC) AS r
    FROM nodes n JOIN totals USING (repo)
    WHERE is_dir OR tokens >= ceil(CAST(total AS DOUBLE) * {min_percent} / 100.0)
  ) WHERE r <= {max_lines} - 1
), others AS (
  SELECT t.repo, total, CAST(total - COALESCE(sum(tokens) FILTER (NOT is_dir), 0) AS BIGINT) AS tokens
  FROM totals t LEFT JOIN shown s USING (repo, total) GROUP BY t.repo, total
), keyed AS (
  SELECT s.repo, s.node, s.depth, s.is_dir, s.tokens, s.total,
         list({{'t': -a.tokens, 'n': regexp_replace(a.node, '^.*/', '')}} ORDER BY a.depth) AS k
  FROM shown s JOIN shown a ON a.repo = s.repo
       AND (a.node = s.node OR starts_with(s.node, a.node || '/'))
  GROUP BY ALL
)
{tail}"""


_TOKEN_MAP_TAIL = """
SELECT repo, CAST(row_number() OVER (PARTITION BY repo ORDER BY other, k) AS INTEGER) AS line, path, name, tokens,
       CASE WHEN total > 0 THEN CAST(tokens AS DOUBLE) / total * 100.0 ELSE 0.0 END AS percentage,
       CAST(depth AS INTEGER) AS depth, is_last, is_dir
FROM (
  SELECT repo, false AS other, k, node AS path, regexp_replace(node, '^.*/', '') AS name, tokens, total,
         depth, is_dir, lead(node) OVER (PARTITION BY repo, regexp_replace(node, '/?[^/]*$', '')
             ORDER BY tokens DESC, regexp_replace(node, '^.*/', '')) IS NULL AS is_last
  FROM keyed
  UNION ALL
  SELECT repo, true, NULL, '(other files)', '(other files)', tokens, total, 0, false, true
  FROM others WHERE tokens > 0
)"""


@register("token_map", _token_map_sql(20, 0.1, _TOKEN_MAP_TAIL))
def token_map(spark: SparkSession, sf: str) -> DataFrame:
    return tokenmap.token_map(corpus(spark, sf))


@register("token_map_short", _token_map_sql(6, 12.0, _TOKEN_MAP_TAIL))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tokenmap.token_map(corpus(spark, sf), max_lines=6, min_percent=12.0)


@register("token_map_nodes", _token_map_sql(20, 0.1, """
SELECT repo, node, is_dir, CAST(depth AS INTEGER) AS depth, tokens FROM shown"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tokenmap.token_map_nodes(corpus(spark, sf))


@register("other_files", _token_map_sql(20, 0.1, """
SELECT repo, tokens FROM others WHERE tokens > 0"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tokenmap.other_files(corpus(spark, sf))


def _flagged(files: DataFrame) -> DataFrame:
    """Selected: below an ``en`` or ``fr`` directory; active: rs, py and md."""
    return files.withColumn(
        "selected", F.col("rel_path").rlike("^(en|fr)/")
    ).withColumn("active", F.coalesce(F.col("ext").isin("rs", "py", "md"), F.lit(False)))


_SEEN = "regexp_matches(rel_path, '^(en|fr)/') AND COALESCE(ext IN ('rs', 'py', 'md'), false)"


@register("visible_totals", over_climbed(f"""
SELECT repo, node, is_dir, count(*) FILTER ({_SEEN}) AS visible_files,
       CAST(COALESCE(sum(tokens) FILTER ({_SEEN}), 0) AS BIGINT) AS visible_tokens
FROM climbed GROUP BY 1, 2, 3"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.visible_totals(_flagged(corpus(spark, sf)))


@register("visible_ext_totals", over_corpus(f"""
SELECT repo, ext, CAST(COALESCE(sum(tokens) FILTER ({_SEEN}), 0) AS BIGINT) AS visible_tokens
FROM corpus WHERE ext IS NOT NULL GROUP BY 1, 2"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.visible_ext_totals(_flagged(corpus(spark, sf)))


@register("selection_state", over_climbed("""
SELECT repo, node, bool_and(sel) AS selected, bool_or(sel) AND NOT bool_and(sel) AS partial
FROM (SELECT *, regexp_matches(rel_path, '^(en|fr)/') OR ext = 'TOML' AND ext IS NOT NULL AS sel FROM climbed WHERE is_dir)
GROUP BY 1, 2"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    picked = F.col("rel_path").rlike("^(en|fr)/") | (
        (F.col("ext") == "TOML") & F.col("ext").isNotNull()
    )
    return rollup.selection_state(
        corpus(spark, sf).withColumn("selected", F.coalesce(picked, F.lit(False)))
    )


_SAVED = (("", False), ("en", True), ("en/m1", False), ("en/m1/sub", True), ("fr/m2", True), ("fr/m2/sub", False), ("de/m4/", True))


def saved_selection(files: DataFrame) -> DataFrame:
    """Nested rows that overrule each other; repositories of names starting with ``src1`` have none at the root."""
    rows = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(s).alias("selected")) for p, s in _SAVED])
    return files.select("repo").distinct().select("repo", F.explode(rows).alias("s")).select("repo", "s.*").where(
        "path <> '' or repo not like 'src1%'"
    )


_CHOSEN = (
    "(SELECT arg_max(s, length(p)) FROM (VALUES "
    + ", ".join(f"('{p.rstrip('/')}', {str(s).lower()})" for p, s in _SAVED)
    + ") v(p, s) WHERE p = '' OR rel_path = p OR starts_with(rel_path, p || '/'))"
)


@register("visible_by_selection", over_climbed(f"""
, chosen AS (SELECT *, {_CHOSEN} AND COALESCE(ext IN ('rs', 'py', 'md'), false) AS seen FROM climbed)
SELECT repo, node, is_dir, count(*) FILTER (seen) AS visible_files,
       CAST(COALESCE(sum(tokens) FILTER (seen), 0) AS BIGINT) AS visible_tokens
FROM chosen GROUP BY 1, 2, 3"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf).select("repo", "rel_path", "ext", "tokens")
    active = files.select("repo", "ext").where("ext in ('rs', 'py', 'md')").distinct()
    return rollup.visible_totals(selection.flag_by_selection(files, saved_selection(files), active))


@register("state_by_selection", over_climbed(f"""
SELECT repo, node, bool_and(sel) AS selected, bool_or(sel) AND NOT bool_and(sel) AS partial
FROM (SELECT *, {_CHOSEN} AS sel FROM climbed WHERE is_dir) GROUP BY 1, 2"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf).select("repo", "rel_path", "ext")
    return rollup.selection_state(selection.flag_by_selection(files, saved_selection(files)))


@register("allowed_nodes", over_climbed("""
SELECT DISTINCT repo, node FROM climbed
WHERE ext = CASE repo WHEN 'src1' THEN 'py' ELSE 'rs' END"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf)
    active = files.select("repo").distinct().withColumn(
        "ext", F.when(F.col("repo") == "src1", "py").otherwise("rs")
    )
    return rollup.allowed_nodes(files, active)


@register("selection_counters", over_corpus("""
SELECT repo, CAST(count(*) FILTER (sel) AS BIGINT) AS selected_files, count(*) AS total_files,
       count(DISTINCT ext) FILTER (sel) AS selected_exts, count(DISTINCT ext) AS total_exts
FROM (SELECT *, regexp_matches(rel_path, '^(en|fr)/') AND COALESCE(ext, '') <> 'md' AS sel FROM corpus)
GROUP BY repo"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    chosen = F.col("rel_path").rlike("^(en|fr)/") & (F.coalesce("ext", F.lit("")) != "md")
    return selection.selection_counters(corpus(spark, sf).withColumn("selected", chosen))


@register("node_paths", over_climbed("""
SELECT repo, rel_path, node AS ancestor, CAST(i AS INTEGER) AS depth FROM climbed"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    climbed = corpus(spark, sf).select(
        "repo", "rel_path", F.explode(ancestors(F.col("rel_path"))).alias("ancestor")
    )
    return climbed.withColumn("depth", depth_of(F.col("ancestor")))
