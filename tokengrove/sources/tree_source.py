"""Directory trees as a data source: ``spark.read.format("file_tree")``, and the same as a stream.

Planning expands directories from the root until there are enough partitions; a partition is a
directory whose entries are shared out by a hash of their names, or a subtree. With ``pushdown`` what a query
asks of path, extension, size and time is pushed down: subtrees that cannot match are not entered, and
files that do not match are not opened. Spark keeps what a query has pushed with the loaded source, so
such a source is for one query; :func:`read_tree` loads a new one each time.

Options: ``path``, ``repo`` (the root's name by default), ``hidden``, ``followSymlinks``, ``noIgnore``,
``content`` (false lists only), ``include`` and ``exclude`` (JSON lists of globs), ``includePriority``,
``partitions`` (64 by default), ``maxFileBytes``, ``pushdown``. The rules are those of :func:`tokengrove.sources.files.scan_files`.
"""

from __future__ import annotations

from collections.abc import Iterator
import json
import os
import re
import time
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)
from pyspark.sql.types import StructType

from tokengrove.functions.globs import RuleSet, globs_regex
from tokengrove.sources.files import Rules, entries, local_path, rules_above

SCHEMA = (
    "repo string, path string, rel_path string, ext string, is_symlink boolean, size bigint, "
    "mtime_us bigint, tokens bigint, content string"
)
_ARROW = pa.schema(
    [
        ("repo", pa.string()),
        ("path", pa.string()),
        ("rel_path", pa.string()),
        ("ext", pa.string()),
        ("is_symlink", pa.bool_()),
        ("size", pa.int64()),
        ("mtime_us", pa.int64()),
        ("tokens", pa.int64()),
        ("content", pa.string()),
    ]
)
_BATCH_BYTES, _BATCH_ROWS = 16 << 20, 4096
#: A stream leaves the last moments to its next batch: clocks of files are coarser than the system's.
SETTLED_US = 200_000

_TESTS = {
    EqualTo: lambda have, want: have == want,
    In: lambda have, want: have in want,
    GreaterThan: lambda have, want: have > want,
    GreaterThanOrEqual: lambda have, want: have >= want,
    LessThan: lambda have, want: have < want,
    LessThanOrEqual: lambda have, want: have <= want,
    StringStartsWith: lambda have, want: have.startswith(want),
    StringEndsWith: lambda have, want: have.endswith(want),
    StringContains: lambda have, want: want in have,
    IsNotNull: lambda have, want: True,
}
_FIELDS = ("path", "rel_path", "ext", "size", "mtime_us")


class FolderPartition(InputPartition):
    """Entry ``share`` of ``shares`` of a directory, with all below it if ``deep``."""

    def __init__(self, folder: str, carried: str, above: list[str], deep: bool, share: int = 0, shares: int = 1):
        self.folder, self.carried, self.above = folder, carried, above
        self.deep, self.share, self.shares = deep, share, shares
        self.since: tuple[int, int] | None = None


class _Walk:
    """What both readers share: options, planning, and the files of a partition."""

    def __init__(self, options: dict[str, str]):
        def flag(name: str) -> bool:
            return options.get(name, "false").lower() == "true"

        self.root = os.path.realpath(local_path(options["path"]))
        self.repo = options.get("repo") or os.path.basename(self.root) or "."
        self.hidden, self.follow = flag("hidden"), flag("followsymlinks")
        self.names = [".ignore"] if flag("noignore") else [".gitignore", ".ignore"]
        self.content = options.get("content", "true").lower() == "true"
        self.width = int(options.get("partitions", "64"))
        self.most = int(options.get("maxfilebytes", str(1 << 20)))
        self.priority = flag("includepriority")
        self.include, self.exclude = (_compiled(json.loads(options.get(k, "[]"))) for k in ("include", "exclude"))
        self.tests: list[tuple[str, type, object]] = []

    def plan(self) -> list[FolderPartition]:
        """Directories are expanded, shallow ones first, until there are ``partitions`` of them."""
        if not os.path.isdir(self.root):
            return []
        stat = os.stat(self.root)
        known: dict[str, RuleSet | None] = {}
        waiting = [(self.root, rules_above(self.root, self.names), [f"{stat.st_dev}:{stat.st_ino}"])]
        done: list[FolderPartition] = []
        while waiting and len(waiting) + len(done) < self.width:
            folder, carried, above = waiting.pop(0)
            rules = Rules(carried, folder, self.names, known)
            files = 0
            for _, _, path, is_dir, _, _, _, below, within in entries(
                self.repo, self.root, folder, self.hidden, self.follow, rules, above
            ):
                if is_dir and self._enters(path):
                    waiting.append((path, below, json.loads(within or "[]")))
                files += not is_dir
            shares = min(self.width, 1 + files // 1000)
            done += [FolderPartition(folder, carried, above, False, k, shares) for k in range(shares if files else 0)]
        return done + [FolderPartition(f, c, a, True) for f, c, a in waiting]

    def _enters(self, folder: str) -> bool:
        """Can a file below match what is asked of paths?"""
        rel = folder[len(self.root.rstrip("/")) + 1 :] + "/"
        for field, kind, want in self.tests:
            here = rel if field == "rel_path" else folder + "/" if field == "path" else None
            if here is None:
                continue
            wants = want if kind is In else [want] if kind in (EqualTo, StringStartsWith) else None
            if wants is not None and not any(w.startswith(here) or kind is StringStartsWith and here.startswith(w) for w in wants):
                return False
        return True

    def _wanted(self, row: dict) -> bool:
        if not 1 <= row["size"] <= self.most:
            return False
        if self.include and not self.include.match(row["rel_path"]):
            return False
        if self.exclude and not self.priority and self.exclude.match(row["rel_path"]):
            return False
        return all(row[f] is not None and _TESTS[kind](row[f], want) for f, kind, want in self.tests)

    def files(self, partition: FolderPartition) -> Iterator[pa.RecordBatch]:
        """The files of a partition; with ``since`` only those that changed after the first and up to the second time."""
        since = partition.since
        known: dict[str, RuleSet | None] = {}
        stack = [(partition.folder, partition.carried, partition.above)]
        rows: list[dict] = []
        held = 0
        start = len(self.root.rstrip("/")) + 1
        while stack:
            folder, carried, above = stack.pop()
            rules = Rules(carried, folder, self.names, known)
            own = folder == partition.folder
            for _, _, path, is_dir, link, size, mtime, below, within in entries(
                self.repo, self.root, folder, self.hidden, self.follow, rules, above
            ):
                if is_dir:
                    if partition.deep and self._enters(path):
                        stack.append((path, below, json.loads(within or "[]")))
                    continue
                if own and zlib.crc32(path.encode()) % partition.shares != partition.share:
                    continue
                name = os.path.basename(path)
                ext = name.rpartition(".")[2] if "." in name[1:] else None
                row = {
                    "repo": self.repo, "path": path, "rel_path": path[start:], "ext": ext, "is_symlink": link,
                    "size": size, "mtime_us": mtime, "tokens": (size + 3) // 4, "content": None,
                }
                if not self._wanted(row):
                    continue
                try:
                    if since is not None and not since[0] < os.stat(path).st_ctime_ns // 1000 <= since[1]:
                        continue
                    if self.content:
                        with open(path, "rb") as f:
                            row["content"] = f.read().decode("utf-8")
                except (OSError, UnicodeDecodeError):
                    continue
                rows.append(row)
                held += size if self.content else 0
                if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


def _compiled(globs: list[str]) -> re.Pattern | None:
    regex = globs_regex(globs)
    return re.compile(regex.removesuffix(r"\z") + r"\Z") if regex else None


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.walk = _Walk(options)

    def partitions(self) -> list[FolderPartition]:
        return self.walk.plan() or [FolderPartition(self.walk.root, "[]", [], False)]

    def read(self, partition: FolderPartition) -> Iterator[pa.RecordBatch]:
        yield from self.walk.files(partition)


class PushingTreeReader(TreeReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            field = one.attribute[0] if len(getattr(one, "attribute", ())) == 1 else None
            if field in _FIELDS and type(one) in _TESTS and getattr(one, "value", True) is not None:
                self.walk.tests.append((field, type(one), getattr(one, "value", None)))
            else:
                yield one


class TreeStreamReader(DataSourceStreamReader):
    """Files by the time they changed: a batch has those of its span, read when it runs.

    It is the time at which contents or name changed, so files that are moved in arrive as well.
    Offsets are times; nothing is listed to draw one.
    """

    def __init__(self, options: dict[str, str]):
        self.walk = _Walk(options)

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() // 1000 - SETTLED_US}

    def partitions(self, start: dict, end: dict) -> list[FolderPartition]:
        out = self.walk.plan() or [FolderPartition(self.walk.root, "[]", [], False)]
        for partition in out:
            partition.since = (start["until"], end["until"])
        return out

    def read(self, partition: FolderPartition) -> Iterator[pa.RecordBatch]:
        yield from self.walk.files(partition)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema: StructType) -> TreeReader:
        options = self._options()
        return (PushingTreeReader if options.get("pushdown") == "true" else TreeReader)(options)

    def streamReader(self, schema: StructType) -> TreeStreamReader:
        return TreeStreamReader(self._options())


def register_tree_source(spark: SparkSession) -> None:
    """Make ``file_tree`` known to a session, which may push filters down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)


def read_tree(spark: SparkSession, path: str, condition: Column | str, **options: str) -> DataFrame:
    """The files of a tree that meet a condition on path, extension, size or time, which is pushed down."""
    register_tree_source(spark)
    return spark.read.format("file_tree").options(path=path, pushdown="true", **options).load().where(condition)
