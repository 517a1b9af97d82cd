"""Version control: snapshots of the documents, and conversations as commit graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokengrove.catalog.base import ORACLES, WHOLE_BYTES, over_corpus, register
from tokengrove.catalog.caching import file_number
from tokengrove.catalog.prompts import _FLAT as FLAT_TREES
from tokengrove.operators import render, vcs
from tokengrove.plans.assemble import assemble
from tokengrove.plans.lineage import cut
from tokengrove.sources.tables import documents_corpus as corpus, read_table


def next_snapshot(files: DataFrame, step: int) -> DataFrame:
    """A later state of the files: some edited, some gone, some new, some respaced."""
    n = file_number() * 17 % 1009 + step
    text = F.col("content")
    edited = (
        F.when(n % 7 == 1, F.concat(F.lit("first line\n"), text, F.lit("\nlast line")))
        .when(n % 7 == 2, F.replace(text, F.lit(" "), F.lit("  ")))
        .when(n % 7 == 3, F.concat(text, F.lit("\n")))
        .otherwise(text)
    )
    path = F.when(n % 11 == 4, F.concat(F.lit("new/"), "rel_path")).otherwise(F.col("rel_path"))
    return files.where(n % 13 != 5).select("repo", path.alias("rel_path"), edited.alias("content"))


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    head = corpus(spark, sf).select("repo", "rel_path", "content")
    index = next_snapshot(head, 0)
    return head, index, next_snapshot(index, 3)


@register("snapshot_diff", over_corpus("""
, later AS (
  SELECT repo, CASE WHEN n % 11 = 4 THEN 'new/' || rel_path ELSE rel_path END AS rel_path, n % 7 AS edit
  FROM (SELECT *, doc_id * 17 % 1009 AS n FROM corpus) WHERE n % 13 <> 5
)
SELECT repo, rel_path, CASE WHEN edit IS NULL THEN 'D' WHEN doc_id IS NULL THEN 'A' ELSE 'M' END AS status
FROM corpus FULL JOIN later USING (repo, rel_path)
WHERE edit IS NULL OR doc_id IS NULL OR edit = 1"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    head, index, _ = snapshots(spark, sf)
    return vcs.snapshot_diff(head, index)


@register("snapshot_diff_tree", ORACLES["snapshot_diff"])
def _(spark: SparkSession, sf: str) -> DataFrame:
    head, index, _ = snapshots(spark, sf)
    return vcs.tree_diff(cut(vcs.snapshot_tree(head)), cut(vcs.snapshot_tree(index)))


def _later_sql(source: str, step: int) -> str:
    """:func:`next_snapshot` of a table ``(repo, rel_path, content, n)``, whose ``n`` is the file's number."""
    k = f"(n * 17 % 1009 + {step})"
    return f"""
  SELECT repo, CASE WHEN {k} % 11 = 4 THEN 'new/' || rel_path ELSE rel_path END AS rel_path, n,
    CASE {k} % 7 WHEN 1 THEN 'first line' || chr(10) || content || chr(10) || 'last line'
      WHEN 2 THEN replace(content, ' ', '  ') WHEN 3 THEN content || chr(10) ELSE content END AS content,
    {k} % 7 = 1 AS edited
  FROM {source} WHERE {k} % 13 <> 5"""


def _lines_sql(text: str, sign: str) -> str:
    """All lines of a text as patch rows."""
    lines = f"list_transform(string_split(regexp_replace({text}, '\\n\\z', ''), chr(10)), lambda x: {{'o': '{sign}', 't': x}})"
    return f"list_concat({lines}, CASE WHEN ends_with({text}, chr(10)) THEN [] ELSE [{{'o': 'N', 't': '\\ No newline at end of file'}}] END)"


def _patch_sql(old: str, new: str) -> str:
    """Patch rows between two tables of :func:`_later_sql`: files come, go, or gain a first and a last line."""
    count = "len(string_split(regexp_replace(content, '\\n\\z', ''), chr(10)))"
    kept = "list_transform(string_split(regexp_replace(o.content, '\\n\\z', ''), chr(10)), lambda x: {'o': ' ', 't': x})"
    place = "CASE k WHEN 1 THEN '1' ELSE '1,' || k END"
    return f"""
  SELECT repo, rel_path, CAST(i - 1 AS INTEGER) AS seq, rows[i].o AS origin, rows[i].t AS text
  FROM (
    SELECT repo, rel_path, CASE
      WHEN o.repo IS NULL THEN list_concat([
        {{'o': 'F', 't': 'diff --git a/' || rel_path || ' b/' || rel_path}}, {{'o': 'F', 't': 'new file mode 100644'}},
        {{'o': 'F', 't': '--- /dev/null'}}, {{'o': 'F', 't': '+++ b/' || rel_path}}, {{'o': 'H', 't': '@@ -0,0 +' || {place.replace('k', 'w.k')} || ' @@'}}],
        {_lines_sql('w.content', '+')})
      WHEN w.repo IS NULL THEN list_concat([
        {{'o': 'F', 't': 'diff --git a/' || rel_path || ' b/' || rel_path}}, {{'o': 'F', 't': 'deleted file mode 100644'}},
        {{'o': 'F', 't': '--- a/' || rel_path}}, {{'o': 'F', 't': '+++ /dev/null'}}, {{'o': 'H', 't': '@@ -' || {place.replace('k', 'o.k')} || ' +0,0 @@'}}],
        {_lines_sql('o.content', '-')})
      ELSE list_concat([
        {{'o': 'F', 't': 'diff --git a/' || rel_path || ' b/' || rel_path}},
        {{'o': 'F', 't': '--- a/' || rel_path}}, {{'o': 'F', 't': '+++ b/' || rel_path}}],
        CASE WHEN o.k <= 6 THEN list_concat(
          [{{'o': 'H', 't': '@@ -' || {place.replace('k', 'o.k')} || ' +1,' || (o.k + 2) || ' @@'}}, {{'o': '+', 't': 'first line'}}], {kept})
        ELSE list_concat([{{'o': 'H', 't': '@@ -1,3 +1,4 @@'}}, {{'o': '+', 't': 'first line'}}], {kept}[1:3],
          [{{'o': 'H', 't': '@@ -' || (o.k - 2) || ',3 +' || (o.k - 1) || ',4 @@'}}], {kept}[o.k - 2:o.k]) END,
        [{{'o': '+', 't': 'last line'}}, {{'o': 'N', 't': '\\ No newline at end of file'}}])
      END AS rows
    FROM (SELECT *, {count} AS k FROM {old}) o FULL JOIN (SELECT *, {count} AS k FROM {new}) w USING (repo, rel_path)
    WHERE o.repo IS NULL OR w.repo IS NULL OR w.edited
  ), LATERAL (SELECT unnest(range(1, len(rows) + 1)) AS i)"""


_STATES = f"""
, head AS (SELECT repo, rel_path, doc_id AS n, content, false AS edited FROM corpus)
, staged AS ({_later_sql('head', 0)})
, unstaged AS ({_later_sql('staged', 3)})"""


@register("patch_lines", over_corpus(_STATES + _patch_sql("head", "staged")))
def _(spark: SparkSession, sf: str) -> DataFrame:
    head, index, _ = snapshots(spark, sf)
    return vcs.patch_lines(head, index)


@register("patch_counts", over_corpus("""
, later AS (
  SELECT repo, CASE WHEN n % 11 = 4 THEN 'new/' || rel_path ELSE rel_path END AS rel_path, n % 7 AS edit,
         len(string_split(content, chr(10))) + CASE n % 7 WHEN 1 THEN 2 ELSE 0 END AS new_lines
  FROM (SELECT *, doc_id * 17 % 1009 AS n FROM corpus) WHERE n % 13 <> 5
)
SELECT repo, rel_path,
       CAST(CASE WHEN doc_id IS NULL THEN new_lines WHEN edit IS NULL THEN 0 ELSE 2 END AS BIGINT) AS added,
       CAST(CASE WHEN doc_id IS NULL THEN 0 WHEN edit IS NULL THEN len(string_split(content, chr(10))) ELSE 0 END AS BIGINT) AS removed
FROM corpus FULL JOIN later USING (repo, rel_path)
WHERE edit IS NULL OR doc_id IS NULL OR edit = 1"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    head, index, _ = snapshots(spark, sf)
    return vcs.patch_lines(head, index).groupBy("repo", "rel_path").agg(
        F.count_if(F.col("origin") == "+").alias("added"),
        F.count_if(F.col("origin") == "-").alias("removed"),
    )


_SECTIONS = f"""
, sections AS (
  SELECT *, 'Staged Changes' AS section FROM ({_patch_sql("head", "staged")})
  UNION ALL SELECT *, 'Unstaged Changes' FROM ({_patch_sql("staged", "unstaged")}))"""


@register("git_sections", over_corpus(_STATES + _SECTIONS + " SELECT * FROM sections"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return vcs.git_sections(*snapshots(spark, sf))


@register("git_diff_prompt", over_corpus(_STATES + _SECTIONS + f"""
, {FLAT_TREES}
, texts AS (
  SELECT repo, section, string_agg(CASE WHEN origin IN (' ', '+', '-') THEN origin ELSE '' END || text || chr(10), ''
           ORDER BY rel_path, seq) AS text
  FROM sections GROUP BY repo, section
), diffs AS (
  SELECT repo, string_agg('--- ' || section || ' ---' || chr(10) || text, chr(10) ORDER BY section) AS diff FROM texts GROUP BY repo
)
SELECT repo, CAST(0 AS BIGINT) AS part, rtrim('Write a commit message: a short imperative subject, then why.' || chr(10) || chr(10)
  || CASE WHEN diff IS NULL THEN '' ELSE '# What changed' || chr(10) || chr(10) || '~~~diff' || chr(10) || diff || chr(10)
     || '~~~' || chr(10) || chr(10) END || '# Files of ' || repo || chr(10) || chr(10) || tree, chr(10)) AS prompt
FROM flat LEFT JOIN diffs USING (repo)"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    from tokengrove.operators.templates import LIBRARY

    head, index, workdir = snapshots(spark, sf)
    diff = vcs.sections_stream(vcs.git_sections(head, index, workdir))
    return render.render_prompts(
        corpus(spark, sf), LIBRARY["commit"], WHOLE_BYTES, streams={"git_diff": diff}
    )


@register("patch_apply", over_corpus(_STATES + """
SELECT repo, rel_path, sha256(content) AS digest FROM staged
WHERE edited OR NOT EXISTS (SELECT 1 FROM head h WHERE h.repo = staged.repo AND h.rel_path = staged.rel_path)"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    head, index, _ = snapshots(spark, sf)
    return vcs.patch_apply(head, vcs.patch_lines(head, index)).select(
        "repo", "rel_path", F.sha2("content", 256).alias("digest")
    )


# ── commit graphs ────────────────────────────────────────────────────────────


def _commit_id(turn):
    return F.sha2(F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string")), 256)


def commit_tables(
    spark: SparkSession, sf: str, merges: bool
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as histories. A turn follows the one before; with ``merges``, two lanes
    alternate and every third turn joins them. ``trunk`` stands half-way, ``feature`` at the end."""
    turns = read_table(spark, sf, "conversations").withColumn(
        "repo", F.concat(F.lit("conv"), F.col("conv_id").cast("string"))
    )
    t = F.col("turn")
    if merges:
        earlier = F.array(
            F.when(t >= 2, _commit_id(t - 2)), F.when((t >= 1) & (t % 3 == 0), _commit_id(t - 1))
        )
    else:
        earlier = F.array(F.when(t >= 1, _commit_id(t - 1)))
    commits = turns.select(
        "repo",
        _commit_id(t).alias("commit"),
        F.array_compact(earlier).alias("parents"),
        (F.lit(1700000000) + t * 60).alias("ts"),
        F.when(F.col("role") == "user", F.element_at(F.split("text", "\n"), 1)).alias("summary"),
    )
    last = turns.groupBy("repo", "conv_id").agg(F.max("turn").alias("turn"))
    half = F.floor(F.col("turn") / 2).cast("bigint")
    refs = last.select(
        "repo", F.lit("feature").alias("branch"), _commit_id(F.col("turn")).alias("commit")
    ).unionByName(
        last.where("conv_id % 10 <> 9").select(
            "repo", F.lit("trunk").alias("branch"), _commit_id(half).alias("commit")
        )
    )
    requests = last.select(
        "repo", F.lit("trunk").alias("branch1"), F.lit("feature").alias("branch2")
    )
    return commits, refs, requests


def _range_sql(merges: bool) -> str:
    parent = "t.turn = r.turn - 2 OR r.turn % 3 = 0 AND t.turn = r.turn - 1" if merges else "t.turn = r.turn - 1"
    return f"""
WITH RECURSIVE last AS (
  SELECT conv_id, max(turn) AS top FROM conversations GROUP BY conv_id
), reach(conv_id, side, turn) AS (
  SELECT conv_id, 2, top FROM last UNION SELECT conv_id, 1, top // 2 FROM last
  UNION
  SELECT r.conv_id, r.side, t.turn FROM reach r JOIN conversations t ON t.conv_id = r.conv_id AND ({parent})
)
SELECT 'conv' || conv_id AS repo, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq,
       substr(sha256(conv_id || ':' || turn), 1, 7) || ' - '
       || CASE role WHEN 'user' THEN string_split(text, chr(10))[1] ELSE 'No commit message' END || chr(10) AS line
FROM conversations c
WHERE conv_id % 10 <> 9
  AND EXISTS (SELECT 1 FROM reach r WHERE r.conv_id = c.conv_id AND r.side = 2 AND r.turn = c.turn)
  AND NOT EXISTS (SELECT 1 FROM reach r WHERE r.conv_id = c.conv_id AND r.side = 1 AND r.turn = c.turn)"""


@register("commit_range", _range_sql(False))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return vcs.commit_range(*commit_tables(spark, sf, merges=False)).select("repo", "seq", "line")


@register("commit_range_merges", _range_sql(True))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return vcs.commit_range(*commit_tables(spark, sf, merges=True)).select("repo", "seq", "line")


@register("git_log_text", "WITH log AS (" + _range_sql(True) + """)
SELECT repo, CAST(0 AS BIGINT) AS part, string_agg(line, '' ORDER BY seq) AS text FROM log GROUP BY repo""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    log = vcs.log_stream(vcs.commit_range(*commit_tables(spark, sf, merges=True)))
    return assemble(log, ["repo"], ["key"], WHOLE_BYTES)


@register("branch_check", """
SELECT DISTINCT 'conv' || conv_id AS repo, 'trunk' AS branch FROM conversations WHERE conv_id % 10 = 9""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, refs, requests = commit_tables(spark, sf, merges=False)
    return vcs.missing_branches(requests, refs)


# ── branches of the documents ────────────────────────────────────────────────


def branch_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Commits, refs, requests and trees: every repository has a ``trunk`` of one commit and a
    ``feature`` two commits ahead; repositories whose name ends in 9 have no trunk."""
    head, index, _ = snapshots(spark, sf)
    repos = head.select("repo").distinct()
    commit = lambda n: F.sha2(F.concat("repo", F.lit(f":{n}")), 256)
    numbered = repos.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    commits = numbered.select(
        "repo",
        F.sha2(F.concat("repo", F.lit(":"), F.col("n").cast("string")), 256).alias("commit"),
        F.when(F.col("n") > 0, F.array(F.sha2(F.concat("repo", F.lit(":"), (F.col("n") - 1).cast("string")), 256)))
        .otherwise(F.array().cast("array<string>"))
        .alias("parents"),
        F.col("n").cast("bigint").alias("ts"),
        F.concat(F.lit("Step "), F.col("n").cast("string"), F.lit(" of "), "repo").alias("summary"),
    )
    refs = repos.where("repo NOT LIKE '%9'").select("repo", F.lit("trunk").alias("branch"), commit(0).alias("commit")).unionByName(
        repos.select("repo", F.lit("feature").alias("branch"), commit(2).alias("commit"))
    )
    requests = repos.select("repo", F.lit("trunk").alias("branch1"), F.lit("feature").alias("branch2"))
    trees = head.withColumn("commit", commit(0)).unionByName(index.withColumn("commit", commit(2)))
    return commits, refs, requests, trees


@register("branch_diff", over_corpus(_STATES + f"""
SELECT repo, 'trunk' AS branch1, 'feature' AS branch2, rel_path, seq, origin, text
FROM ({_patch_sql("head", "staged")}) WHERE repo NOT LIKE '%9'"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, refs, requests, trees = branch_tables(spark, sf)
    return vcs.branch_diff(requests, refs, trees)


@register("render_pull_request", over_corpus(_STATES + f"""
, {FLAT_TREES}
, diffs AS (
  SELECT repo, string_agg(CASE WHEN origin IN (' ', '+', '-') THEN origin ELSE '' END || text || chr(10), ''
           ORDER BY rel_path, seq) AS diff
  FROM ({_patch_sql("head", "staged")}) WHERE repo NOT LIKE '%9' GROUP BY repo
)
SELECT repo, CAST(0 AS BIGINT) AS part, rtrim('Describe a pull request: motivation, changes, how to try it.' || chr(10) || chr(10)
  || CASE WHEN repo LIKE '%9' THEN '' ELSE '# Commits, oldest first' || chr(10) || chr(10)
     || substr(sha256(repo || ':1'), 1, 7) || ' - Step 1 of ' || repo || chr(10)
     || substr(sha256(repo || ':2'), 1, 7) || ' - Step 2 of ' || repo || chr(10) || chr(10) END
  || '# Files of ' || repo || chr(10) || chr(10) || tree || chr(10)
  || CASE WHEN diff IS NULL THEN '' ELSE '# Changes of the branch' || chr(10) || chr(10) || '~~~diff' || chr(10) || diff
     || chr(10) || '~~~' END, chr(10)) AS prompt
FROM flat LEFT JOIN diffs USING (repo)"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    from tokengrove.operators.templates import LIBRARY

    commits, refs, requests, trees = branch_tables(spark, sf)
    streams = {
        "git_diff_branch": vcs.diff_stream(vcs.branch_diff(requests, refs, trees)),
        "git_log_branch": vcs.log_stream(vcs.commit_range(commits, refs, requests)),
    }
    return render.render_prompts(corpus(spark, sf), LIBRARY["pull-request"], WHOLE_BYTES, streams=streams)
