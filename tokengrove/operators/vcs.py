"""Snapshots, patches and commit ranges over version-control tables.

``snapshots(repo, rel_path, content)`` is one state of the files,
``commits(repo, commit, parents ARRAY<STRING>, ts, summary)`` the history,
``refs(repo, branch, commit)`` the branch heads and
``requests(repo, branch1, branch2)`` what is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tokengrove.functions.lines import common_lines
from tokengrove.functions.paths import ancestors, parent_of
from tokengrove.plans.lineage import cut
from tokengrove.plans.skew import salted_join
from tokengrove.plans.slices import ranked

KEY = ["repo", "rel_path"]
CONTEXT = 3  # fixed value: unchanged lines around a change
FILE_MODE = "100644"  # fixed value: a plain file
NO_NEWLINE = "\\ No newline at end of file"  # fixed value
FLUSH_BYTES = 4 << 20  # what a task has made leaves in batches of about so much
_APPLIED = pa.schema([("repo", pa.string()), ("rel_path", pa.string()), ("content", pa.string())])
PATCH_SCHEMA = "repo string, rel_path string, seq int, origin string, text string"
WHITE = " \t\r\f\v"  # fixed value: characters that comparisons of lines leave out


def _digest(content: Column) -> Column:
    """Equal for contents whose lines agree up to white space."""
    # Plain functions on bytes: patterns over all of a text take most of a diff's time.
    bare = reduce(lambda text, c: F.replace(text, F.lit(c), F.lit("")), WHITE, content)

    def unended(text: Column) -> Column:
        return F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text)

    # Inside a lambda ``bare`` is a value, so it is made once.
    return F.sha2(F.transform(F.array(bare), unended)[0], 256)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths added (``A``), deleted (``D``) or modified (``M``) between two snapshots.

    Only digests are shuffled, never contents.
    """
    left = old.select(*KEY, _digest(F.col("content")).alias("_old"))
    right = new.select(*KEY, _digest(F.col("content")).alias("_new"))
    status = (
        F.when(F.col("_old").isNull(), "A").when(F.col("_new").isNull(), "D").otherwise("M")
    )
    return (
        left.join(right, KEY, "full_outer")
        .where(~F.col("_old").eqNullSafe(F.col("_new")))
        .select(*KEY, status.alias("status"))
    )


def snapshot_tree(files: DataFrame) -> DataFrame:
    """A snapshot's nodes ``(repo, node, parent, is_dir, digest)``, to be stored beside it; the root is ``''``.

    A directory's digest is the number of files below it and two sums without carry of hashes of their paths and
    contents, which tasks add up before anything is shuffled: equal subtrees have equal digests.
    """
    leaf = files.select(*KEY, _digest(F.col("content")).alias("_d")).select(
        "repo",
        F.col("rel_path").alias("node"),
        F.struct(
            F.lit(1).cast("bigint").alias("files"),
            F.xxhash64("rel_path", "_d").alias("x"),
            F.xxhash64(F.lit(1), "_d", "rel_path").alias("y"),
        ).alias("digest"),
    )

    def added(rows: DataFrame, *key: Column) -> DataFrame:
        sums = F.struct(
            F.sum("digest.files").alias("files"), F.bit_xor("digest.x").alias("x"), F.bit_xor("digest.y").alias("y")
        )
        return rows.groupBy(*key).agg(sums.alias("digest"))

    direct = added(leaf.withColumn("dir", parent_of(F.col("node"))), "repo", "dir")
    dirs = added(direct.withColumn("node", F.explode(ancestors(F.col("dir")))), "repo", "node")
    nodes = dirs.withColumn("is_dir", F.lit(True)).unionByName(leaf.withColumn("is_dir", F.lit(False)))
    parent = F.when(F.col("node") != "", parent_of(F.col("node")))
    return nodes.select("repo", "node", parent.alias("parent"), "is_dir", "digest")


def differing_levels(old: DataFrame, new: DataFrame) -> Iterator[DataFrame]:
    """Level by level the nodes ``(repo, node, is_dir, status)`` in which two stored trees differ.

    Only children of directories that differ are compared, so a change in one file
    reads one path of directories; a level without differences ends it.
    """
    open_dirs = None
    while True:
        sides = []
        for tree, name in ((old, "_old"), (new, "_new")):
            level = tree.select("repo", "node", "parent", "is_dir", F.col("digest").alias(name))
            if open_dirs is None:
                level = level.where(F.col("parent").isNull())
            else:
                level = salted_join(level, open_dirs, ["repo", "parent"], "left_semi", ["node"])
            sides.append(level.drop("parent"))
        status = F.when(F.col("_old").isNull(), "A").when(F.col("_new").isNull(), "D").otherwise("M")
        found = cut(
            sides[0]
            .join(sides[1], ["repo", "node", "is_dir"], "full_outer")
            .where(~F.col("_old").eqNullSafe(F.col("_new")))
            .select("repo", "node", "is_dir", status.alias("status"))
        )
        if found.isEmpty():
            return
        yield found
        open_dirs = found.where("is_dir").select("repo", F.col("node").alias("parent"))


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """:func:`snapshot_diff` of two stored trees, see :func:`snapshot_tree`. Runs a job per level that differs."""
    nothing = old.limit(0).select("repo", F.col("node").alias("rel_path"), F.lit("").alias("status"))
    levels = [
        level.where("not is_dir").select("repo", F.col("node").alias("rel_path"), "status")
        for level in differing_levels(old, new)
    ]
    return reduce(DataFrame.unionByName, levels, nothing)


def _split(text: str | None) -> list[str]:
    if not text:
        return []
    lines = text.split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def _bare(text: str | None, count: int) -> list[str]:
    """The first ``count`` lines of a text without white space, which is taken out of the text as a whole."""
    return reduce(lambda s, c: s.replace(c, ""), WHITE, text or "").split("\n")[:count]


def _hunks(pairs: list[tuple[int, int]], n: int, m: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Changes ``(i1, i2, j1, j2)`` between matched lines, those whose contexts meet in one hunk."""
    group: list[tuple[int, int, int, int]] = []
    i = j = 0
    for next_i, next_j in [*pairs, (n, m)]:
        if i < next_i or j < next_j:
            if group and i - group[-1][1] > 2 * CONTEXT:
                yield group
                group = []
            group.append((i, next_i, j, next_j))
        i, j = next_i + 1, next_j + 1
    if group:
        yield group


def _range(start: int, count: int) -> str:
    """A hunk's place in one version: lines count from 1, an empty place names the line before it."""
    first = start + 1 if count else start
    return f"{first}" if count == 1 else f"{first},{count}"


def file_patch(path: str, old: str | None, new: str | None) -> Iterator[tuple[str, str]]:
    """``(origin, line)`` of one file's patch; origins ``F`` file, ``H`` hunk, space, ``+``, ``-``.

    Lines compare without white space, and context shows the new version. Origin ``N`` follows a
    last line that does not end in a newline. The lines kept are a longest common subsequence.
    """
    yield "F", f"diff --git a/{path} b/{path}"
    if old is None:
        yield "F", f"new file mode {FILE_MODE}"
    if new is None:
        yield "F", f"deleted file mode {FILE_MODE}"
    yield "F", "--- " + ("/dev/null" if old is None else f"a/{path}")
    yield "F", "+++ " + ("/dev/null" if new is None else f"b/{path}")
    a, b = _split(old), _split(new)
    pairs = common_lines(_bare(old, len(a)), _bare(new, len(b)))
    open_a = bool(old) and not old.endswith("\n")
    open_b = bool(new) and not new.endswith("\n")

    def shown(origin: str, lines: list[str], start: int, stop: int, unended: bool) -> Iterator[tuple[str, str]]:
        yield from ((origin, s) for s in lines[start:stop])
        if unended and start < stop == len(lines):
            yield "N", NO_NEWLINE

    for group in _hunks(pairs, len(a), len(b)):
        before = min(CONTEXT, group[0][0])
        after = min(CONTEXT, len(a) - group[-1][1])
        i1, i2 = group[0][0] - before, group[-1][1] + after
        j1, j2 = group[0][2] - before, group[-1][3] + after
        yield "H", f"@@ -{_range(i1, i2 - i1)} +{_range(j1, j2 - j1)} @@"
        at = j1
        for a1, a2, b1, b2 in group:
            yield from shown(" ", b, at, b1, open_b)
            yield from shown("-", a, a1, a2, open_a)
            yield from shown("+", b, b1, b2, open_b)
            at = b2
        yield from shown(" ", b, at, j2, open_b)


def _patch_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["repo", "rel_path", "seq", "origin", "text"]
    for batch in batches:
        rows: list[tuple] = []
        for row in batch.itertuples(index=False):
            patch = enumerate(file_patch(row.rel_path, row.old, row.new))
            rows += [(row.repo, row.rel_path, seq, origin, text) for seq, (origin, text) in patch]
            if len(rows) >= 10_000:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def patch_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """Line patches ``(repo, rel_path, seq, origin, text)`` of the files that differ.

    Contents join back for changed files only, on the file's own key.
    """
    changed = snapshot_diff(old, new).select(*KEY)
    pairs = changed.join(
        old.select(*KEY, F.col("content").alias("old")), KEY, "left"
    ).join(new.select(*KEY, F.col("content").alias("new")), KEY, "left")
    return pairs.mapInPandas(_patch_batches, PATCH_SCHEMA)


def apply_patch(old: str | None, patch: list[tuple[str, str]]) -> str | None:
    """The new version of a file from the old one and its patch, null for a deleted file.

    Lines outside hunks are taken as the old version has them.
    """
    if ("F", "+++ /dev/null") in patch:
        return None
    source, out, at, ended, previous = _split(old), [], 0, True, ""
    place = re.compile(r"@@ -(\d+)(?:,(\d+))? ")
    for origin, text in patch:
        if origin == "H":
            start, count = place.match(text).groups()
            upto = int(start) - (count != "0")
            out += source[at:upto]
            at = upto
        elif origin in " -":
            at += 1
        if origin in " +":
            out.append(text)
            ended = True
        elif origin == "N" and previous != "-":
            ended = False
        previous = origin
    if at < len(source):
        out += source[at:]
        ended = old.endswith("\n")
    return "\n".join(out) + ("\n" if ended and out else "")


def _apply_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One file's patch is Python objects at a time, of which a line takes many times its bytes."""
    for batch in batches:
        rows: list[dict] = []
        held = 0
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            content = apply_patch(row["old"], [(p["origin"], p["text"]) for p in row["patch"]])
            rows.append({"repo": row["repo"], "rel_path": row["rel_path"], "content": content})
            held += len(content or "")
            if held >= FLUSH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, _APPLIED)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _APPLIED)


def patch_apply(old: DataFrame, patches: DataFrame) -> DataFrame:
    """``(repo, rel_path, content)`` after the patches, of patched files that remain.

    A group is one file's patch, which is no larger than the two versions of the file.
    """
    whole = patches.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("seq", "origin", "text"))).alias("patch")
    )
    pairs = whole.join(old.select(*KEY, F.col("content").alias("old")), KEY, "left")
    return pairs.mapInArrow(_apply_groups, "repo string, rel_path string, content string").where("content IS NOT NULL")


def git_sections(head: DataFrame, index: DataFrame, workdir: DataFrame) -> DataFrame:
    """Patches of staged (head to index) and unstaged (index to work tree) changes, by ``section``."""
    staged = patch_lines(head, index).withColumn("section", F.lit("Staged Changes"))
    unstaged = patch_lines(index, workdir).withColumn("section", F.lit("Unstaged Changes"))
    return staged.unionByName(unstaged)


def _patch_text() -> Column:
    mark = F.when(F.col("origin").isin(" ", "+", "-"), F.col("origin")).otherwise("")
    return F.concat(mark, "text", F.lit("\n"))


def diff_stream(patches: DataFrame) -> DataFrame:
    """Patch lines as prompt lines ``(repo, key, text)``, written out: a prompt reads them repeatedly."""
    return cut(patches).select(
        "repo",
        F.array("rel_path", F.lpad(F.col("seq").cast("string"), 10, "0")).alias("key"),
        _patch_text().alias("text"),
    )


def sections_stream(sections: DataFrame) -> DataFrame:
    """Sections as prompt lines, a heading before each and an empty line between the two.

    The patches are written out, as a prompt reads them repeatedly.
    """
    sections = cut(sections)
    order = F.when(F.col("section") == "Staged Changes", "1").otherwise("2")
    lines = sections.select(
        "repo",
        F.array(
            order, F.lit("b"), F.col("rel_path"), F.lpad(F.col("seq").cast("string"), 10, "0")
        ).alias("key"),
        _patch_text().alias("text"),
    )
    present = sections.groupBy("repo").agg(
        F.bool_or(F.col("section") == "Staged Changes").alias("_staged"),
        F.bool_or(F.col("section") == "Unstaged Changes").alias("_unstaged"),
    )
    gap = F.when(F.col("_staged"), F.lit("\n")).otherwise("")
    heads = present.select(
        "repo",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(
                        F.col("_staged"),
                        F.struct(F.lit("1").alias("o"), F.lit("--- Staged Changes ---\n").alias("t")),
                    ),
                    F.when(
                        F.col("_unstaged"),
                        F.struct(
                            F.lit("2").alias("o"),
                            F.concat(gap, F.lit("--- Unstaged Changes ---\n")).alias("t"),
                        ),
                    ),
                )
            )
        ).alias("h"),
    ).select("repo", F.array("h.o", F.lit("a")).alias("key"), F.col("h.t").alias("text"))
    return heads.unionByName(lines)


def missing_branches(requests: DataFrame, refs: DataFrame) -> DataFrame:
    """Requested branches that do not exist, ``(repo, branch)``."""
    asked = requests.select("repo", F.explode(F.array("branch1", "branch2")).alias("branch"))
    return asked.distinct().join(refs.select("repo", "branch"), ["repo", "branch"], "left_anti")


def valid_requests(requests: DataFrame, refs: DataFrame) -> DataFrame:
    """Requests both of whose branches exist; the others yield nothing."""
    heads = refs.select("repo", "branch")
    return requests.join(
        heads.withColumnRenamed("branch", "branch1"), ["repo", "branch1"], "left_semi"
    ).join(heads.withColumnRenamed("branch", "branch2"), ["repo", "branch2"], "left_semi").select(
        "repo", "branch1", "branch2"
    )


BRANCHES = ["repo", "branch1", "branch2"]


def branch_diff(requests: DataFrame, refs: DataFrame, trees: DataFrame) -> DataFrame:
    """Patch lines from the tree of ``branch1`` to that of ``branch2``, for every request.

    ``trees(repo, commit, rel_path, content)`` has the files of each commit. Returns ``(repo,
    branch1, branch2, rel_path, seq, origin, text)``; a request naming a missing branch, or one
    whose trees agree, returns nothing. Requests for one repository are patched side by side:
    the request is part of the file's key.
    """
    asked = valid_requests(requests, refs)
    packed = F.to_json(F.struct(*BRANCHES))

    def side(branch: str) -> DataFrame:
        heads = asked.join(refs.select("repo", F.col("branch").alias(branch), "commit"), ["repo", branch])
        return salted_join(trees, heads, ["repo", "commit"], "inner", ["rel_path"]).select(
            packed.alias("repo"), "rel_path", "content"
        )

    lines = patch_lines(side("branch1"), side("branch2"))
    fields = F.from_json("repo", "repo string, branch1 string, branch2 string")
    return lines.select(fields.alias("_request"), "rel_path", "seq", "origin", "text").select(
        "_request.*", "rel_path", "seq", "origin", "text"
    )


#: Commits times requests of a repository that one task walks; positions of a chain that a request joins at a time.
SMALL_WALK, CHAIN_BLOCK = 1_000_000, 1024


def _hop(rows: DataFrame, beyond: DataFrame) -> DataFrame:
    """Follow each pointer of ``rows`` as far as that of the commit it points to.

    A commit that is done meets its own row, so no root becomes a hot key.
    """
    moving = F.when(F.col("done"), F.col("commit")).otherwise(F.col("up"))
    return (
        rows.withColumn("_at", moving)
        .join(beyond, ["repo", "_at"])
        .withColumn("up", F.when(F.col("done"), F.col("up")).otherwise(F.col("_up")))
        .withColumn("dist", F.col("dist") + F.when(F.col("done"), 0).otherwise(F.col("_dist")))
        .withColumn("done", F.col("done") | F.col("_done"))
        .drop("_at", "_up", "_dist", "_done")
    )


def _chains(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut a commit graph into chains of first parents.

    First parents make a forest. A commit belongs to the chain of the deepest leaf above it
    (the newest commit of the longest line; ties by id), and its position is its distance from the root, so a
    main line is one chain however many branches fork from it. Returns ``(repo, commit, chain, pos)``
    and the edges between chains, ``(repo, chain, pos, to, to_pos)``. Pointers and the leaf known
    so far move four times as far each round: eight rounds for a line of sixty thousand commits.
    """
    key = commits.select("repo", "commit", "parents")
    edges = cut(
        key.select("repo", "commit", F.posexplode("parents").alias("_nth", "parent")).join(
            key.select("repo", F.col("commit").alias("parent")), ["repo", "parent"], "left_semi"
        )
    )
    first = edges.groupBy("repo", "commit").agg(F.min_by("parent", "_nth").alias("parent"))
    leaf = F.struct(F.lit(0).cast("bigint").alias("height"), F.col("commit").alias("leaf"))
    state = cut(
        key.select("repo", "commit")
        .join(first, ["repo", "commit"], "left")
        .select(
            "repo",
            "commit",
            F.coalesce("parent", "commit").alias("up"),
            F.col("parent").isNotNull().cast("bigint").alias("dist"),
            F.col("parent").isNull().alias("done"),
            leaf.alias("best"),
        )
    )
    total, step = state.count(), 1

    def offered(rows: DataFrame, far: int) -> DataFrame:
        """The best leaf of each row, to the commit ``far`` below."""
        best = F.struct((F.col("best.height") + far).alias("height"), F.col("best.leaf").alias("leaf"))
        return rows.where(F.col("dist") == far).select("repo", F.col("up").alias("commit"), best.alias("_best"))

    while True:
        if step > 4 * total:
            raise ValueError("the commit graph has a cycle")
        beyond = state.select(
            "repo", F.col("commit").alias("_at"), F.col("up").alias("_up"), F.col("dist").alias("_dist"), F.col("done").alias("_done")
        )
        hops = [state.where("not done")]
        for _ in range(3):
            hops.append(_hop(hops[-1], beyond))
        offers = offered(state, step).unionByName(offered(hops[1], 2 * step)).unionByName(offered(hops[2], 3 * step))
        best = offers.groupBy("repo", "commit").agg(F.max("_best").alias("_best"))
        settled = state.where("not done").isEmpty()
        state = cut(
            state.where("done")
            .unionByName(hops[3])
            .join(best, ["repo", "commit"], "left")
            .withColumn("best", F.greatest("best", F.coalesce("_best", "best")))
            .drop("_best")
        )
        if settled:
            break
        step *= 4
    places = state.select("repo", "commit", F.col("best.leaf").alias("chain"), F.col("dist").alias("pos"))
    cross = (
        edges.select("repo", "commit", "parent")
        .join(places, ["repo", "commit"])
        .join(
            places.select("repo", F.col("commit").alias("parent"), F.col("chain").alias("to"), F.col("pos").alias("to_pos")),
            ["repo", "parent"],
        )
        .where("chain <> to")
        .select("repo", "chain", "pos", "to", "to_pos")
        .distinct()
    )
    return places, cut(cross)


def _reached(heads: DataFrame, cross: DataFrame) -> tuple[DataFrame, int]:
    """``(repo, head, chain, limit)``: the highest position of each chain that a head reaches, and the rounds it took.

    All heads spread at once, each walked once per repository. A chain counts again only
    if it is entered higher than before, so what merges into a line and forks from it again
    takes two rounds, however many there are.
    """
    seen = heads
    frontier = heads.withColumn("_from", F.lit(-1).cast("bigint"))
    rounds = 0
    while True:
        entered = (
            salted_join(cross, frontier, ["repo", "chain"], "inner", ["pos", "to"])
            .where((F.col("pos") <= F.col("limit")) & (F.col("pos") > F.col("_from")))
            .groupBy("repo", "head", F.col("to").alias("chain"))
            .agg(F.max("to_pos").alias("limit"))
        )
        before = seen.withColumnRenamed("limit", "_from")
        frontier = cut(
            entered.join(before, ["repo", "head", "chain"], "left")
            .withColumn("_from", F.coalesce("_from", F.lit(-1).cast("bigint")))
            .where(F.col("limit") > F.col("_from"))
        )
        if frontier.isEmpty():
            return seen, rounds
        rounds += 1
        seen = cut(
            seen.unionByName(frontier.drop("_from")).groupBy("repo", "head", "chain").agg(F.max("limit").alias("limit"))
        )


def _walked(history: list[tuple], asked: list[tuple]) -> Iterator[tuple] | None:
    """``(branch1, branch2, seq, commit, summary)`` of one repository; None if its history has a cycle."""
    known = {commit: (() if parents is None else parents) for commit, parents, _, _ in history}
    waiting = dict.fromkeys(known, 0)  # children not yet passed
    for parents in known.values():
        for p in parents:
            if p in waiting:
                waiting[p] += 1
    free = [c for c, n in waiting.items() if not n]
    for c in free:
        for p in known[c]:
            if p in waiting:
                waiting[p] -= 1
                if not waiting[p]:
                    free.append(p)
    if len(free) < len(known):
        return None
    reached: dict[str, set[str]] = {}

    def reach(head: str) -> set[str]:
        if head not in reached:
            seen, stack = {head}, [head]
            while stack:
                for p in known[stack.pop()]:
                    if p in known and p not in seen:
                        seen.add(p)
                        stack.append(p)
            reached[head] = seen
        return reached[head]

    # By time, nulls first, and id.
    order = sorted(history, key=lambda c: (c[2] is not None, c[2] or 0, c[0]))

    def ranges() -> Iterator[tuple]:
        for one, two, head1, head2 in asked:
            if head1 in known and head2 in known:
                wanted = reach(head2) - reach(head1)
                kept = (c for c in order if c[0] in wanted)
                yield from ((one, two, seq, c[0], c[3]) for seq, c in enumerate(kept, 1))

    return ranges()


def _small_ranges(commits: DataFrame, sides: DataFrame) -> DataFrame:
    """:func:`commit_range` of repositories whose history is walked in one task, a group of bounded size.

    Returns ``(repo, branch1, branch2, seq, commit, summary)``, and a row without ``seq`` for a cyclic history.
    """
    columns = ["repo", "branch1", "branch2", "seq", "commit", "summary"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows: list[tuple] = []

        def close() -> None:
            if held:
                repo = held[0][0]
                history = [r[1:5] for r in held if r[1] is not None]
                found = _walked(history, [r[5:] for r in held if r[1] is None])
                rows.extend([(repo, *[None] * 5)] if found is None else ((repo, *r) for r in found))
                held.clear()

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if held and held[0][0] != row[0]:
                    close()
                held.append(row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], columns)
                rows.clear()
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], columns)

    text = pa.string()
    kinds = [text, text, text, pa.int64(), text, text]
    none = F.lit(None).cast("string")
    names = ["branch1", "branch2", "_head1", "_head2"]
    history = commits.select("repo", "commit", "parents", "ts", "summary", *[none.alias(c) for c in names])
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in history.schema.fields[1:5]]
    asked = sides.select("repo", *empty, *names)
    return (
        history.unionByName(asked)
        .repartition("repo")
        .sortWithinPartitions("repo")
        .mapInArrow(walk, "repo string, branch1 string, branch2 string, seq bigint, commit string, summary string")
    )


def commit_range(commits: DataFrame, refs: DataFrame, requests: DataFrame) -> DataFrame:
    """Commits reachable from ``branch2`` and not from ``branch1``, oldest first.

    Returns ``(repo, branch1, branch2, seq, commit, line)``; requests naming a missing
    branch return nothing. A repository with few commits and requests is walked as one group. In the others a
    head reaches all of a chain of first parents up to one position, so a request is a range of each
    chain; it meets the commits of its range only.
    """
    asked = valid_requests(requests, refs)
    at = refs.select("repo", "branch", F.col("commit").alias("head"))
    sides = asked
    for k in (1, 2):
        head = at.select("repo", F.col("branch").alias(f"branch{k}"), F.col("head").alias(f"_head{k}"))
        sides = sides.join(head, ["repo", f"branch{k}"])
    sides = cut(sides)
    who = ["repo", "branch1", "branch2"]
    line = F.concat(
        F.substring("commit", 1, 7),
        F.lit(" - "),
        F.coalesce("summary", F.lit("No commit message")),
        F.lit("\n"),
    )
    steps = commits.groupBy("repo").agg(F.count(F.lit(1)).alias("_n")).join(
        sides.groupBy("repo").agg(F.count(F.lit(1)).alias("_asked")), "repo"
    )
    steps = cut(steps.select("repo", (F.col("_n") * (F.col("_asked") + 1) <= SMALL_WALK).alias("_small")))

    def part(rows: DataFrame, small: bool) -> DataFrame:
        chosen = steps.where("_small" if small else "not _small").select("repo")
        return salted_join(rows, chosen, ["repo"], "left_semi", ["commit"] if "commit" in rows.columns else who)

    found = _small_ranges(part(commits, True), part(sides, True))
    found = cut(found)
    if not found.where("seq is null").isEmpty():
        raise ValueError("the commit graph has a cycle")
    found = found.select(*who, "seq", "commit", line.alias("line"))
    if steps.where("not _small").isEmpty():
        return found
    return found.unionByName(_large_ranges(part(commits, False), part(sides, False), line))


def _large_ranges(commits: DataFrame, sides: DataFrame, line: Column) -> DataFrame:
    """:func:`commit_range` by chains."""
    who = ["repo", "branch1", "branch2"]
    commits, sides = cut(commits), cut(sides)
    places, cross = _chains(commits)
    named = sides.select("repo", F.explode(F.array("_head1", "_head2")).alias("commit")).distinct()
    heads = cut(
        named.join(places, ["repo", "commit"]).select(
            "repo", F.col("commit").alias("head"), "chain", F.col("pos").alias("limit")
        )
    )
    reach, _ = _reached(heads, cross)

    def side(k: int) -> DataFrame:
        found = reach.withColumnRenamed("head", f"_head{k}")
        return sides.select(*who, f"_head{k}").join(found, ["repo", f"_head{k}"]).select(*who, "chain", F.col("limit").alias(f"_to{k}"))

    block = lambda c: F.floor(F.col(c) / CHAIN_BLOCK).cast("bigint")
    ranges = (
        side(2)
        .join(side(1), [*who, "chain"], "left")
        .withColumn("_to1", F.coalesce("_to1", F.lit(-1).cast("bigint")))
        .where("_to2 > _to1")
        .withColumn("_low", F.col("_to1") + 1)
        .withColumn("_block", F.explode(F.sequence(block("_low"), block("_to2"))))
    )
    inside = (
        salted_join(places.withColumn("_block", block("pos")), ranges, ["repo", "chain", "_block"], "inner", ["commit"])
        .where((F.col("pos") <= F.col("_to2")) & (F.col("pos") > F.col("_to1")))
        .select(*who, "commit")
        .join(commits.select("repo", "commit", "ts", "summary"), ["repo", "commit"])
    )
    return ranked(
        inside, who, [F.col("ts"), F.col("commit")], "seq"
    ).select(*who, "seq", "commit", line.alias("line"))


def log_stream(commits_in_range: DataFrame) -> DataFrame:
    """A commit range as prompt lines ``(repo, key, text)``."""
    return commits_in_range.select(
        "repo",
        F.array(F.lpad(F.col("seq").cast("string"), 12, "0")).alias("key"),
        F.col("line").alias("text"),
    )
