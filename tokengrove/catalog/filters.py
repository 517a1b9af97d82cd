"""Scans, guards, filters, selection and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokengrove.catalog.base import over_corpus, register
from tokengrove.functions.paths import path_label, strip_root
from tokengrove.functions.text import ascii_lower, sha256_hex
from tokengrove.operators import filters, ignore, order, selection
from tokengrove.sources.tables import documents_corpus as corpus, pages_corpus, read_table

KEY = ["repo", "rel_path"]


@register("corpus_view", over_corpus("""
SELECT repo, path, rel_path, ext, size, mtime_us, content, tokens FROM corpus"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf)


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with some emptied and some repeated past the size limit."""
    doc, text = F.col("doc_id"), F.col("text")
    body = (
        F.when(doc % 13 == 0, F.lit(""))
        .when(doc % 97 == 1, F.repeat(text, 400))
        .otherwise(text)
    )
    return read_table(spark, sf, "documents").select(
        F.col("source").alias("repo"), "doc_id", F.octet_length(body).cast("bigint").alias("size")
    )


@register("scan_sizes", """
SELECT source AS repo, doc_id, size FROM (
  SELECT *, CAST(CASE WHEN doc_id % 13 = 0 THEN 0 WHEN doc_id % 97 = 1 THEN strlen(text) * 400
                 ELSE strlen(text) END AS BIGINT) AS size FROM documents)
WHERE size >= 1 AND size <= 1048576""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return filters.size_guard(_sized(spark, sf))


@register("utf8_guard", """
SELECT doc_id, text AS content FROM documents WHERE doc_id % 5 <> 2""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.encode("text", "UTF-8")
    broken = F.concat(raw, F.unhex(F.lit("FFFE")))
    stored = read_table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 5 == 2, broken).otherwise(raw).alias("content")
    )
    return filters.utf8_guard(stored)


@register("hidden_filter", over_corpus("""
SELECT repo, rel_path FROM corpus WHERE NOT regexp_matches(rel_path, '(^|/)[.]')"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return filters.drop_hidden(corpus(spark, sf)).select(*KEY)


@register("symlink_filter", over_corpus("""
SELECT repo, rel_path FROM corpus WHERE doc_id % 10 <> 4"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    linked = F.regexp_extract("rel_path", r"d(\d+)(?:\.[^.]*)?$", 1).cast("bigint") % 10 == 4
    return filters.drop_symlinks(corpus(spark, sf).withColumn("is_symlink", linked)).select(*KEY)


@register("rel_paths", over_corpus("""
SELECT repo, path, CASE WHEN repo = 'src3' THEN path ELSE rel_path END AS rel_path FROM corpus"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf)
    back = F.replace(F.col("path"), F.lit("/"), F.lit("\\"))
    root = F.concat(
        F.lit("/corpus/"), F.when(F.col("repo") == "src3", "elsewhere").otherwise(F.col("repo"))
    )
    return files.select("repo", "path", strip_root(back, root).alias("rel_path"))


@register("extensions", """
SELECT doc_id, name, CASE WHEN regexp_matches(name, '^.+[.][^.]*$')
       THEN regexp_extract(name, '^.+[.]([^.]*)$', 1) END AS ext
FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '.env' WHEN 1 THEN 'a.tar.gz' WHEN 2 THEN 'a.'
        WHEN 3 THEN lang || '.' || source WHEN 4 THEN 'noext' ELSE '.x.' || lang END AS name FROM documents)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from tokengrove.functions.paths import extension_of

    kind = F.col("doc_id") % 6
    name = (
        F.when(kind == 0, F.lit(".env"))
        .when(kind == 1, F.lit("a.tar.gz"))
        .when(kind == 2, F.lit("a."))
        .when(kind == 3, F.concat("lang", F.lit("."), "source"))
        .when(kind == 4, F.lit("noext"))
        .otherwise(F.concat(F.lit(".x."), "lang"))
    )
    named = read_table(spark, sf, "documents").select("doc_id", name.alias("name"))
    return named.withColumn("ext", extension_of(F.concat(F.lit("some.dir/"), "name")))


def _glob_query(name: str, where: str, **options) -> None:
    @register(name, over_corpus(f"SELECT repo, rel_path FROM corpus WHERE {where}"))
    def _(spark: SparkSession, sf: str) -> DataFrame:
        return filters.filter_globs(corpus(spark, sf), **options).select(*KEY)


def _full(*regexes: str) -> str:
    return "(" + " OR ".join(f"regexp_full_match(rel_path, '(?s){r}')" for r in regexes) + ")"


_glob_query(
    "glob_include",
    _full(r".*\.py", r"(?:.*/)?sub/d[0-4].*", r"fr/m./d.*\.(?:md|txt)"),
    include=["*.py", "**/sub/d[0-4]*", "fr/m?/d*.{md,txt}"],
)
_glob_query(
    "glob_exclude",
    "NOT " + _full(r"(?:.*/)?m[^3-9]/.*", r"en/.*"),
    exclude=["**/m[!3-9]/**", "en/**"],
)
_glob_query(
    "glob_priority",
    _full(r"(?:.*/)?en/.*", r".*\.rs"),
    include=["**/en/**", "*.rs"],
    exclude=["**/*.rs", "**/sub/**"],
    include_priority=True,
)
_glob_query(
    "glob_both",
    _full(r"(?:.*/)?en/.*", r".*\.rs") + " AND NOT " + _full(r"(?:.*/)?[^/]*\.rs", r".*/sub/.*"),
    include=["**/en/**", "*.rs"],
    exclude=["**/*.rs", "**/sub/**"],
)
_glob_query(
    "glob_dialect",
    _full(r".*/m[a-f0-4]/.*d.\.rs", r"e.*/m./(?:.*/)?d1.*", r"de/.*9\.(?:rs|t.*)"),
    include=["*/m[a-f0-4]/*d?.rs", "e*/m?/**/d1*", r"de/*9.{rs,t*}", r"no\*star"],
)


@register("extension_sugar", over_corpus(
    "SELECT repo, rel_path FROM corpus WHERE ext IN ('rs', 'py') OR " + _full(r"es/.*")))
def _(spark: SparkSession, sf: str) -> DataFrame:
    patterns = filters.include_patterns(["es/*"], ["rs", "py"])
    return filters.filter_globs(corpus(spark, sf), include=patterns).select(*KEY)


@register("default_excludes", over_corpus("""
SELECT repo, spot FROM (
  SELECT repo, CASE doc_id % 9 WHEN 0 THEN '.git/' || rel_path WHEN 1 THEN 'a/node_modules/' || rel_path
    WHEN 2 THEN 'target/' || rel_path WHEN 3 THEN rel_path || '.exe' WHEN 4 THEN rel_path || '.dll'
    WHEN 5 THEN '.svn/' || rel_path WHEN 6 THEN 'x/.hg/' || rel_path WHEN 7 THEN 'targets/' || rel_path
    ELSE rel_path END AS spot, doc_id FROM corpus)
WHERE (doc_id % 9 = 7 OR doc_id % 9 = 8) AND spot NOT LIKE '%.md'"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("rel_path")
    kind = F.regexp_extract(path, r"d(\d+)(?:\.[^.]*)?$", 1).cast("bigint") % 9
    spot = F.element_at(
        F.array(
            F.concat(F.lit(".git/"), path),
            F.concat(F.lit("a/node_modules/"), path),
            F.concat(F.lit("target/"), path),
            F.concat(path, F.lit(".exe")),
            F.concat(path, F.lit(".dll")),
            F.concat(F.lit(".svn/"), path),
            F.concat(F.lit("x/.hg/"), path),
            F.concat(F.lit("targets/"), path),
            path,
        ),
        (kind + 1).cast("int"),
    )
    patterns = filters.exclude_patterns(config=["*.md"])
    return filters.filter_globs(
        corpus(spark, sf).select("repo", spot.alias("spot")), exclude=patterns, path="spot"
    )


@register("glob_table", over_corpus("""
SELECT repo, rel_path FROM corpus
WHERE CASE WHEN repo = 'src0' THEN true
           WHEN repo LIKE 'src1%' THEN ext = 'py' AND ext IS NOT NULL AND NOT rel_path LIKE '%/sub/%'
           ELSE NOT rel_path LIKE '%/sub/%' END"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf)
    repos = files.select("repo").distinct().where("repo <> 'src0'")
    globs = repos.where("repo like 'src1%'").select(
        "repo", F.lit("include").alias("kind"), F.lit("**/*.py").alias("glob")
    ).unionByName(
        repos.select("repo", F.lit("exclude").alias("kind"), F.lit("**/sub/**").alias("glob"))
    )
    return filters.filter_glob_table(files, globs).select(*KEY)


@register("ignore_rules", over_corpus(r"""
SELECT repo, rel_path FROM corpus WHERE NOT (
  -- /.gitignore: "*.txt", "!d1*.txt", "m3/", "/de/m5"
  CASE WHEN regexp_matches(rel_path, '(^|/)d1[^/]*\.txt$')
            THEN regexp_matches(rel_path, '^(\.cfg/)?en/') AND regexp_matches(rel_path, '^en/.*4\.txt$')
       WHEN regexp_matches(rel_path, '\.txt$')
            THEN NOT regexp_matches(rel_path, '^en/m[^/]*/d[^/]*4\.txt$') OR regexp_matches(rel_path, '^en/.*/sub/')
       -- /en/.gitignore: "sub/", "!/*/d*4.txt" and, last, "d1*4.txt"
       ELSE false END
  OR regexp_matches(rel_path, '(^|/)m3/')
  OR regexp_matches(rel_path, '^de/m5/')
  OR regexp_matches(rel_path, '^en/(.*/)?sub/'))"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf).select("repo", "rel_path", "content")
    ignore_files = files.select("repo").distinct().select(
        "repo",
        F.explode(
            F.create_map(
                F.lit(".gitignore"),
                F.lit("# texts\n*.txt\n!d1*.txt\n\nm3/\n/de/m5\n"),
                F.lit("en/.gitignore"),
                F.lit("sub/\n!/*/d*4.txt\nd1*4.txt\n"),
            )
        ).alias("rel_path", "content"),
    )
    return ignore.drop_ignored(files, ignore.read_rules(ignore_files)).select(*KEY)


@register("select_files", over_corpus("""
SELECT repo, rel_path FROM corpus
WHERE ext IN ('rs', 'TOML') AND regexp_matches(rel_path, '^(en/m1|fr)/')"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return selection.select_files(corpus(spark, sf), ["rs", "TOML"], ["EN/m1", "fr"]).select(*KEY)


@register("select_by_table", over_corpus("""
SELECT repo, rel_path FROM corpus
WHERE (repo <> 'src1' OR COALESCE(ext, '') IN ('rs', 'md'))
  AND (repo <> 'src2' OR regexp_matches(rel_path, '^(en/m1|fr)/'))
  AND (repo <> 'src5' OR COALESCE(ext, '') = 'py' AND regexp_matches(rel_path, '^en/'))"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf)
    return selection.select_by_table(files, _selection(files)).select(*KEY)


def _selection(files: DataFrame) -> DataFrame:
    """Saved selections of three repositories: one by extension, one by path, one by both."""
    rows = F.array(
        *[
            F.struct(F.lit(r).alias("r"), F.lit(k).alias("kind"), F.lit(v).alias("value"))
            for r, k, v in (
                ("src1", "extension", "rs"),
                ("src1", "extension", "md"),
                ("src2", "directory", "EN/M1"),
                ("src2", "directory", "fr/"),
                ("src5", "extension", "py"),
                ("src5", "directory", "en"),
            )
        ]
    )
    repos = files.select("repo").distinct()
    return repos.select("repo", F.explode(rows).alias("s")).where("s.r = repo").select(
        "repo", "s.kind", "s.value"
    )


@register("prefix_semi", over_corpus("""
SELECT repo, rel_path FROM corpus
WHERE repo = 'src2' AND regexp_matches(rel_path, '^(en/m1|fr)/') OR repo = 'src5' AND starts_with(rel_path, 'en/')"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf)
    return selection.prefix_hits(files, _selection(files).where("kind = 'directory'"))


@register("prefix_cover", over_corpus("""
, picked AS (
  SELECT DISTINCT repo, rel_path FROM corpus WHERE ext = 'rs'
  UNION SELECT DISTINCT repo, dir FROM corpus WHERE dir LIKE '%/m1' OR dir LIKE '%/sub' OR dir LIKE 'de/%'
  UNION SELECT DISTINCT repo, 'fr' FROM corpus WHERE repo LIKE 'src1%'
)
SELECT repo, rel_path FROM picked p WHERE NOT EXISTS (
  SELECT 1 FROM picked q WHERE q.repo = p.repo AND starts_with(p.rel_path, q.rel_path || '/'))"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    from tokengrove.functions.paths import parent_of

    files = corpus(spark, sf).select("repo", "rel_path", "ext")
    dirs = files.select("repo", parent_of(F.col("rel_path")).alias("rel_path"))
    path = F.col("rel_path")
    picked = (
        files.where("ext = 'rs'").select(*KEY)
        .unionByName(dirs.where(path.endswith("/m1") | path.endswith("/sub") | path.startswith("de/")))
        .unionByName(
            files.where(F.col("repo").startswith("src1")).select("repo", F.lit("fr").alias("rel_path"))
        )
    )
    return selection.prefix_cover(picked)


@register("ext_search", over_corpus("""
SELECT DISTINCT repo, ext FROM corpus WHERE ext IS NOT NULL AND contains(lower(ext), 'om')"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    exts = corpus(spark, sf).select("repo", "ext").where("ext is not null").distinct()
    return selection.search_extensions(exts, "oM")


@register("path_value", over_corpus("""
SELECT repo, path AS absolute, rel_path AS relative FROM corpus WHERE ext IS NOT NULL"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    from tokengrove.operators.render import path_value

    files = corpus(spark, sf).withColumn("content", F.when(F.col("ext").isNotNull(), F.col("content")))
    shown = files.where(F.col("content").isNotNull())
    return shown.select("repo", path_value(True).alias("absolute"), path_value(False).alias("relative"))


@register("path_label", over_corpus("""
SELECT repo, rel_path, regexp_replace(rel_path, '^.*/', '') AS label, repo AS root_label FROM corpus"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select(
        "repo",
        "rel_path",
        path_label(F.concat("path", F.lit("/"))).alias("label"),
        path_label(F.lit("/"), "?").alias("_none"),
        path_label(F.concat(F.lit("/corpus/"), "repo")).alias("root_label"),
    ).drop("_none")


def _order_query(name: str, method: str, by: str) -> None:
    @register(name, over_corpus(f"""
SELECT repo, rel_path, row_number() OVER (PARTITION BY repo ORDER BY {by}) AS rank FROM corpus"""))
    def _(spark: SparkSession, sf: str) -> DataFrame:
        files = corpus(spark, sf).select("repo", "rel_path", "mtime_us")
        return order.rank_files(files, method).select("repo", "rel_path", "rank")


_order_query("sort_name_asc", "name-asc", "parts")
_order_query("sort_name_desc", "name-desc", "parts DESC")
_order_query("sort_date_asc", "date-asc", "mtime_us NULLS FIRST, parts")
_order_query("sort_date_desc", "date-desc", "mtime_us DESC NULLS LAST, parts")


@register("sha256", over_corpus("""
SELECT repo, rel_path, sha256(path) AS path_key, sha256(content) AS digest FROM corpus"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select(
        "repo",
        "rel_path",
        sha256_hex(F.col("path")).alias("path_key"),
        sha256_hex(F.col("content")).alias("digest"),
    )


@register("ascii_fold", """
SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded
FROM documents""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select(
        "doc_id", ascii_lower(F.col("text")).alias("folded")
    )


@register("pages_view", """
WITH bare AS (
  SELECT page_id, html, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS b FROM pages
), cut AS (
  SELECT page_id, html, regexp_extract(b, '^([^/]*)', 1) AS repo,
         regexp_replace(regexp_replace(b, '^[^/]*/?', ''), '/+$', '') AS tail FROM bare
)
SELECT repo, CASE WHEN tail = '' THEN '' ELSE tail || '/' END || 'p' || page_id || '.html' AS rel_path,
       'html' AS ext, CAST(strlen(html) AS BIGINT) AS size, html AS content FROM cut""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pages_corpus(spark, sf).select("repo", "rel_path", "ext", "size", "content")
