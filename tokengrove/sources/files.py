"""Scanning directory trees that executors can reach.

Listing goes in rounds: a task lists a few thousand entries below each directory that it is given and hands on the
directories left, so a broad tree lists in parallel, a small one in one round, and each round is written out. A directory's ignore files are read when it is
listed and their paths travel down with the rows, so ignored and hidden directories are never
entered. Filters apply to the listing, before any file is opened; reading is spread by
path, so one crowded directory is not one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
import json
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tokengrove.functions.globs import RuleSet, compiled_rules
from tokengrove.functions.paths import extension_of
from tokengrove.functions.tokens import tokens_bytes4
from tokengrove.operators.cache import cache_content, cache_lookup, cache_misses
from tokengrove.operators.filters import MAX_FILE_BYTES, filter_globs
from tokengrove.plans.lineage import cut

_ENTRY = (
    "repo string, root string, path string, is_dir boolean, is_symlink boolean, "
    "size bigint, mtime_us bigint, rules string, above string"
)
_BATCH_ROWS = 4096
_TOGETHER = 4096  # entries that a task lists below one directory before it hands on the directories left
_KNOWN_RULES = 100_000  # compiled ignore files, and missing ones, that a task keeps
_BATCH_BYTES = 32 * 1024 * 1024


def local_path(uri: str) -> str:
    """The path of a ``file:`` URI or plain path; other stores are not trees of files."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:") :].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri} is not a mounted directory")
    return uri


class Rules:
    """The ignore rules that hold in one directory: of its own files and of those above.

    The deepest file with a matching rule decides, by its last one; files named ``.ignore``
    come before all ``.gitignore`` files. ``carried`` lists the ignore files above by name and folder; their
    text is not carried. ``known`` keeps what a task has compiled, by path.
    """

    def __init__(self, carried: str, folder: str, names: list[str], known: dict[str, RuleSet | None]):
        self.files: list[list[str]] = json.loads(carried)  # [name, folder], shallow to deep
        self.compiled: list[tuple[str, int, RuleSet]] = []
        for name, base in [*self.files, *([name, folder] for name in names)]:
            path = os.path.join(base, name)
            if path not in known:
                if len(known) >= _KNOWN_RULES:
                    known.clear()
                known[path] = _read_rules(path)
            rules = known[path]
            if rules is not None:
                self.compiled.append((name, len(base.rstrip("/")) + 1, rules))
                if base == folder:
                    self.files.append([name, folder])
        self.carried = json.dumps(self.files)

    def ignored(self, path: str, is_dir: bool) -> bool:
        for kind in (".ignore", ".gitignore"):
            for name, start, rules in reversed(self.compiled):
                if name == kind:
                    found = rules.ignored(path[start:], is_dir)
                    if found is not None:
                        return found
        return False


def _read_rules(path: str) -> RuleSet | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return compiled_rules(f.read().split("\n"))
    except OSError:
        return None


def rules_above(root: str, names: list[str]) -> str:
    """The ignore files in directories above a root, as :class:`Rules` carries them.

    ``.ignore`` files count in all of them, ``.gitignore`` files from the nearest directory on that
    holds a repository, if the root does not hold it itself.
    """
    folders, at = [], root
    while os.path.dirname(at) != at:
        at = os.path.dirname(at)
        folders.append(at)
    tops = [root, *folders]
    top = next((k for k, f in enumerate(tops) if os.path.exists(os.path.join(f, ".git"))), 0)
    found = []
    for k, folder in reversed(list(enumerate(folders, 1))):
        for name in names:
            if (name == ".ignore" or k <= top) and os.path.isfile(os.path.join(folder, name)):
                found.append([name, folder])
    return json.dumps(found)


def entries(
    repo: str, root: str, folder: str, hidden: bool, follow: bool, rules: Rules, above: list[str]
) -> Iterator[tuple]:
    try:
        scan = os.scandir(folder)
    except OSError:
        return
    with scan:
        for entry in scan:
            if not hidden and entry.name.startswith("."):
                continue
            try:
                link = entry.is_symlink()
                if link and not follow:
                    continue
                is_dir = entry.is_dir()
                if not is_dir and not entry.is_file():
                    continue
                stat = entry.stat()
            except OSError:
                continue
            if rules.ignored(entry.path, is_dir):
                continue
            within = ""
            if is_dir and follow:
                here = f"{stat.st_dev}:{stat.st_ino}"
                if here in above:
                    continue  # leads back to a directory above itself
                within = json.dumps([*above, here])
            carried = rules.carried if is_dir else ""
            yield repo, root, entry.path, is_dir, link, stat.st_size, stat.st_mtime_ns // 1000, carried, within


def _width(spark: SparkSession) -> int:
    """A set number of tasks: paths are few bytes and would be coalesced into one otherwise."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def list_files(
    spark: SparkSession,
    roots: DataFrame | str,
    hidden: bool = False,
    follow_symlinks: bool = False,
    no_ignore: bool = False,
) -> DataFrame:
    """Regular files below each root: ``repo, path, rel_path, ext, is_symlink, size, mtime_us``.

    ``roots`` is one directory or a table ``(repo, root)``; a root that is a link counts as its
    target. Hidden directories, and what ``.gitignore`` (unless ``no_ignore``) and ``.ignore``
    files rule out, are not descended into; entries that cannot be read are skipped. Ignore files above
    a root count as :func:`rules_above` says. Runs a job for each round, of which a deep and large tree takes most.
    """
    if isinstance(roots, str):
        root = os.path.realpath(local_path(roots))
        roots = spark.createDataFrame(
            [(os.path.basename(root) or ".", root)], "repo string, root string"
        )
    columns = [c.strip().split()[0] for c in _ENTRY.split(",")]
    names = [".ignore"] if no_ignore else [".gitignore", ".ignore"]

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        known: dict[str, RuleSet | None] = {}
        for batch in batches:
            for repo, root, folder, carried, above in batch.itertuples(index=False):
                if folder is None:  # a root
                    root = folder = os.path.realpath(local_path(root))
                    try:
                        stat = os.stat(root)
                    except OSError:
                        continue
                    above = json.dumps([f"{stat.st_dev}:{stat.st_ino}"])
                    carried = rules_above(root, names)
                waiting, seen = [(repo, root, folder, True, False, 0, 0, carried, above)], 0
                while waiting:
                    at = waiting.pop()
                    if seen >= _TOGETHER:
                        rows.append(at)
                        continue
                    rules = Rules(at[-2], at[2], names, known)
                    for row in entries(repo, root, at[2], hidden, follow_symlinks, rules, json.loads(at[-1] or "[]")):
                        (waiting if row[3] and seen < _TOGETHER else rows).append(row)
                        seen += 1
                        if len(rows) >= _BATCH_ROWS:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
        yield pd.DataFrame(rows, columns=columns).astype({"is_dir": bool, "is_symlink": bool})

    level = roots.select(
        "repo",
        "root",
        F.lit(None).cast("string").alias("folder"),
        F.lit("[]").alias("rules"),
        F.lit("").alias("above"),
    )
    levels: list[DataFrame] = []
    left = level.count()
    while True:
        width = max(1, min(left, _width(spark)))  # an empty task costs a Python worker as well
        found = cut(level.repartition(width, "repo", "folder").mapInPandas(listing, _ENTRY))
        levels.append(found.where("not is_dir"))
        level = found.where("is_dir").select("repo", "root", F.col("path").alias("folder"), "rules", "above")
        left = level.count()
        if not left:
            break
    files = reduce(DataFrame.unionByName, levels)
    rel_path = F.substring(F.col("path"), F.length(F.rtrim("root", F.lit("/"))) + 2, F.length("path"))
    return files.select(
        "repo",
        "path",
        rel_path.alias("rel_path"),
        extension_of(rel_path).alias("ext"),
        "is_symlink",
        "size",
        "mtime_us",
    )


def read_contents(listing: DataFrame) -> DataFrame:
    """Add ``content``; files that are unreadable or not UTF-8 drop out, nothing is replaced."""
    columns = listing.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listing.schema.fields)

    def reading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for row in batch.itertuples(index=False):
                try:
                    with open(row.path, "rb") as f:
                        text = f.read().decode("utf-8")
                except (OSError, UnicodeDecodeError):
                    continue
                rows.append((*row, text))
                held += row.size
                if held >= _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=[*columns, "content"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=[*columns, "content"])

    return listing.repartition(_width(listing.sparkSession), "path").mapInPandas(reading, schema + ", content string")


def scan_files(
    spark: SparkSession,
    roots: DataFrame | str,
    hidden: bool = False,
    follow_symlinks: bool = False,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    include_priority: bool = False,
    no_ignore: bool = False,
    max_file_bytes: int = MAX_FILE_BYTES,
    cache: DataFrame | None = None,
    tokenizer: str = "bytes4",
    count: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Text files of acceptable size below the roots, in the corpus schema plus ``is_symlink``.

    Ignore files, globs and sizes decide on the listing. With a ``cache`` only files that it does
    not know are opened and counted by ``count``; the others take their tokens and body from it.
    Without ``count`` tokens are the estimate by bytes.
    """
    listing = list_files(spark, roots, hidden, follow_symlinks, no_ignore)
    sized = listing.where(F.col("size").between(1, max_file_bytes))
    wanted = filter_globs(sized, list(include), list(exclude), include_priority)
    count = count or (lambda df: df.withColumn("tokens", tokens_bytes4(F.col("size"))))
    if cache is None:
        return count(read_contents(wanted))
    wanted = cut(wanted)
    fresh = count(read_contents(cache_misses(wanted, cache, tokenizer)))
    known = cache_lookup(wanted, cache, tokenizer).where("hit").drop("hit")
    bodies = cache_content(known, cache, wanted.withColumn("content", F.lit(None).cast("string")).limit(0), tokenizer)
    return fresh.unionByName(bodies.select(*fresh.columns))
