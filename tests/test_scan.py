import os
import re
import time

import pytest
from pyspark.sql import functions as F

from tokengrove.catalog import load, scanning
from tokengrove.operators import cache, filters, ignore
from tokengrove.plans.lineage import cut, discard
from tokengrove.sources import files as files_source
from tokengrove.sources.files import list_files, local_path, scan_files
from tokengrove.sources.tree_source import SETTLED_US, _Walk, read_tree, register_tree_source
from tokengrove.streaming import incremental
from tokengrove.streaming.incremental import append_batch, compact_cache, current_cache, incremental_scan, scan_stream

QUERIES = load()[0]


def make(root, files):
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)


def test_scan(spark, tmp_path):
    root = tmp_path / "proj"
    make(root, {
        "__init__.py": b"i", "_x": b"u", ".env": b"e", "a.tar.gz": b"t", "a.": b"d", "noext": b"n",
        "empty": b"", "one/two/three/deep.rs": b"fn", "limit": b"x" * 1048576, "over": b"x" * 1048577,
        "bin": b"\xff\xfe", "nul": b"a\0b", ".hid/x": b"h",
    })
    os.symlink(root / "noext", root / "link")
    os.symlink(root, root / "one" / "loop")
    os.symlink(root / "one" / "two", root / "dirlink")
    rows = {r.rel_path: r for r in scan_files(spark, str(root)).collect()}
    assert set(rows) == {"__init__.py", "_x", "a.tar.gz", "a.", "noext", "one/two/three/deep.rs", "limit", "nul"}
    assert rows["a."].ext == "" and rows["a.tar.gz"].ext == "gz" and rows["noext"].ext is None
    assert rows["one/two/three/deep.rs"].content == "fn" and rows["noext"].repo == "proj"
    assert rows["limit"].tokens == 262144 and rows["noext"].mtime_us > 0
    hidden = {r.rel_path for r in scan_files(spark, str(root), hidden=True).collect()}
    assert hidden - set(rows) == {".env", ".hid/x"}
    linked = {r.rel_path: r.is_symlink for r in scan_files(spark, str(root), follow_symlinks=True).collect()}
    assert set(linked) - set(rows) == {"link", "dirlink/three/deep.rs"} and linked["link"]
    back = filters.drop_symlinks(scan_files(spark, str(root), follow_symlinks=True))
    assert "link" not in {r.rel_path for r in back.collect()}


def test_ignore_files_of_a_scan(spark, tmp_path):
    root = tmp_path / "p"
    make(root, {".gitignore": b"*.log\nout/\n", "sub/.gitignore": b"!k.log\n", "a.log": b"1", "sub/k.log": b"2", "out/x": b"3", "y": b"4"})
    found = scan_files(spark, str(root), hidden=True)
    rules = ignore.read_rules(found)
    kept = filters.drop_hidden(ignore.drop_ignored(found, rules))
    assert {r.rel_path for r in kept.collect()} == {"sub/k.log", "y"}
    assert list_files(spark, str(tmp_path / "none")).count() == 0
    assert local_path("file:///a/b") == "/a/b" and local_path("/a") == "/a"


LISTING = "repo string, rel_path string, mtime_us bigint, size bigint, content string, tokens bigint"


def test_cache(spark):
    listing = spark.createDataFrame([("r", p, 10, 4, f"new {p}", 1) for p in "abcdef"], LISTING)
    base = [("a", 10, 4, "t", 7, 1), ("b", 11, 4, "t", 7, 1), ("c", 10, 5, "t", 7, 1), ("d", 10, 4, "other", 7, 1), ("e", 10, 4, "t", 7, 0)]
    old = spark.createDataFrame(
        [("r", p, m, s, "x", t, n, f"old {p}", v) for p, m, s, t, n, v in base],
        "repo string, rel_path string, mtime_us bigint, size bigint, sha256 string, tokenizer string, tokens bigint, content string, cache_version int",
    )
    got = {r.rel_path: (r.hit, r.tokens) for r in cache.cache_lookup(listing, old, "t").collect()}
    assert got["a"] == (True, 7) and all(got[p] == (False, None) for p in "bcdef")
    fresh = cache.cache_rows(cache.cache_misses(listing, old, "t"), "t")
    once = cache.cache_upsert(old, fresh)
    twice = cache.cache_upsert(once, fresh)
    assert sorted(once.collect()) == sorted(twice.collect()) and once.count() == 6
    assert cache.cache_misses(listing, once, "t").count() == 0
    body = {r.rel_path: r.content for r in cache.cache_content(listing, old, listing, "t").collect()}
    assert body == {"a": "old a"} | {p: f"new {p}" for p in "bcdef"}


def rows_read(df):
    """What the scan of ``df`` hands on, once it has run."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().get("numOutputRows").get().value()


def test_indexed_cache(spark, tmp_path):
    """Few files, few repositories, many of both: the same hits as in the whole cache, from few of its rows."""
    n = F.col("id")
    files = spark.range(60_000).select(
        F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), (n % 100).cast("string"))).alias("repo"),
        F.concat(F.lit("src/"), n.cast("string"), F.lit(".py")).alias("rel_path"),
        n.alias("mtime_us"),
        (n % 7).alias("size"),
        (n % 50).alias("tokens"),
        F.sha2(n.cast("string"), 512).alias("content"),
    )
    whole = cache.cache_rows(files, "t")
    path = str(tmp_path / "indexed")
    cache.write_cache(whole, path, group_bytes=1 << 16)
    # the newest of these differs from the cache, one is not in it, one repeats and one has no path
    asked = files.where("mtime_us in (5, 30000, 59999)").withColumn("size", F.when(F.col("mtime_us") == 59999, -1).otherwise(F.col("size")))
    others = spark.createDataFrame(
        [("r5", "src/none.py", 1, 1), ("r5", "src/5.py", 5, 5), ("r5", None, 5, 5)],
        "repo string, rel_path string, mtime_us bigint, size bigint",
    )
    few = asked.select(*cache.LOOKUP_KEY).unionByName(others)

    def lookup(listing, known):
        return sorted((str(r.rel_path), r.hit, r.tokens) for r in cache.cache_lookup(listing, known, "t").collect())

    found = lookup(few, cache.narrowed_cache(few, path))
    assert found == lookup(few, whole) and [hit for _, hit, _ in found].count(True) == 3
    assert 3 <= rows_read(cache.narrowed_cache(few, path)) < 6_000
    some = files.where("repo in ('r1', 'r50')").select(*cache.LOOKUP_KEY)
    assert lookup(some, cache.narrowed_cache(some, path)) == lookup(some, whole)
    assert 800 <= rows_read(cache.narrowed_cache(some, path)) < 10_000
    every = files.select(*cache.LOOKUP_KEY)
    assert rows_read(cache.narrowed_cache(every, path, few=10)) == 60_000
    assert cache.cache_misses(every, cache.narrowed_cache(every, path, few=10), "t").count() == 0
    bodies = cache.cache_content(few, cache.narrowed_cache(few, path), files, "t").collect()
    assert len(bodies) == 6 and [r.content for r in bodies].count(None) == 2
    assert cache.narrowed_cache(few.limit(0), path).count() == 0
    nothing = str(tmp_path / "nothing")
    cache.write_cache(whole.limit(0), nothing)
    assert [hit for _, hit, _ in lookup(few, cache.narrowed_cache(few, nothing))] == [False] * 6


def test_stream_equals_batch_and_replays(spark, tmp_path):
    landing, table = str(tmp_path / "landing"), str(tmp_path / "cache")

    def arrive(rows, n):
        spark.createDataFrame([("r", *r) for r in rows], LISTING).coalesce(1).write.parquet(f"{landing}/drop={n}")

    def run(state):
        stream = spark.readStream.schema(LISTING).parquet(landing)
        incremental_scan(stream, table, str(tmp_path / state)).awaitTermination()

    arrive([("a", 1, 3, "aaa", 1), ("b", 1, 3, "bbb", 1)], 0)
    run("s")
    arrive([("a", 2, 4, "aaaa", 1), ("b", 1, 3, "bbb", 1), ("a", 3, 5, "aaaaa", 2), ("c", 1, 1, "c", 1)], 1)
    run("s")
    expected = {"a": "aaaaa", "b": "bbb", "c": "c"}
    assert {r.rel_path: r.content for r in current_cache(spark, table).collect()} == expected
    batches = spark.read.parquet(table).groupBy("run", "batch").count().orderBy("run", "batch").collect()
    assert [(r.run, r.batch, r["count"]) for r in batches] == [(0, 0, 2), (0, 1, 2)]
    # The last batch written once more, as after a failure, changes nothing.
    append_batch(spark, table, cut(current_cache(spark, table).where("rel_path <> 'b'")), 1)
    assert {r.rel_path: r.content for r in current_cache(spark, table).collect()} == expected
    assert current_cache(spark, str(tmp_path / "nowhere")).count() == 0


def test_new_checkpoint_loses_nothing(spark, tmp_path):
    table = str(tmp_path / "cache")

    def run(landing, state, rows):
        spark.createDataFrame([("r", *r) for r in rows], LISTING).repartition(3).write.parquet(str(tmp_path / landing))
        stream = spark.readStream.schema(LISTING).parquet(str(tmp_path / landing))
        incremental_scan(stream, table, str(tmp_path / state)).awaitTermination()

    run("one", "first", [("a", 5, 3, "aaa", 1), ("b", 5, 3, "bbb", 1)])
    run("two", "second", [("c", 1, 1, "c", 1), ("a", 9, 4, "aaaa", 1)])
    expected = {"a": "aaaa", "b": "bbb", "c": "c"}
    assert {r.rel_path: r.content for r in current_cache(spark, table).collect()} == expected
    compact_cache(spark, table, str(tmp_path / "short"))
    assert {r.rel_path: r.content for r in current_cache(spark, str(tmp_path / "short")).collect()} == expected


def test_ignored_folders_are_not_entered(spark, tmp_path):
    root = tmp_path / "garden"
    make(root, {
        ".gitignore": b"compost/\n*.tmp\n!keep.tmp\n/seeds.txt\n", "beds/.gitignore": b"*.md\n", "beds/.ignore": b"!plan.md\n",
        "compost/a": b"1", "x.tmp": b"1", "keep.tmp": b"1", "seeds.txt": b"1", "beds/seeds.txt": b"1", "beds/plan.md": b"1",
        "beds/other.md": b"1", "beds/deep/other.md": b"1", "other.md": b"1", "beds/compost": b"a file, not a folder",
    })
    names = lambda **o: {r.rel_path for r in scan_files(spark, str(root), **o).collect()}
    kept = {"keep.tmp", "beds/seeds.txt", "beds/plan.md", "other.md", "beds/compost"}
    assert names() == kept
    assert names(no_ignore=True) == kept | {"compost/a", "x.tmp", "seeds.txt", "beds/other.md", "beds/deep/other.md"}
    assert names(include=["**/*.md"], exclude=["beds/**"]) == {"other.md"}
    assert names(max_file_bytes=1) == kept - {"beds/compost"}


def test_linked_roots_and_cycles(spark, tmp_path):
    real, other = tmp_path / "real", tmp_path / "other"
    make(real, {"f.py": b"x"})
    make(other, {"g.py": b"y"})
    os.symlink(real, tmp_path / "link")
    os.symlink(real, real / "loop")
    os.symlink(other, real / "aside")
    os.symlink(other, other / "again")
    roots = spark.createDataFrame([("r", str(tmp_path / "link"))], "repo string, root string")
    found = sorted(r.rel_path for r in list_files(spark, roots, follow_symlinks=True).collect())
    assert found == ["aside/g.py", "f.py"]


def wood(root):
    body = {f"d{i}/{'x' * (i % 3)}e{i}/f{j}.{'py' if j % 2 else 'md'}": b"l" * (i + j + 1) for i in range(7) for j in range(5)}
    body |= {".gitignore": b"d6/\n*.tmp\n", "d1/.gitignore": b"!a.tmp\n", "d1/a.tmp": b"1", "d2/a.tmp": b"2", ".h/x.py": b"3"}
    body |= {"bad": b"\xff\xfe", "empty": b"", "d3/.ignore": b"f1.py\n", "top.py": b"top"}
    make(root, body)
    return body


@pytest.mark.parametrize("partitions", [1, 64])
def test_tree_source_equals_the_scan(spark, tmp_path, partitions):
    wood(tmp_path / "wood")
    register_tree_source(spark)
    keys = ["repo", "path", "rel_path", "ext", "is_symlink", "size", "mtime_us", "content"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*keys).collect())
    source = spark.read.format("file_tree").options(path=str(tmp_path / "wood"), partitions=str(partitions)).load()
    assert rows(source) == rows(scan_files(spark, str(tmp_path / "wood"))) != []
    scanned = cut(scan_files(spark, str(tmp_path / "wood")))
    globs = {"include": ["**/*.py"], "exclude": ["d2/**"]}
    options = {k: str(v).replace("'", '"') for k, v in globs.items()}
    asked = spark.read.format("file_tree").options(path=str(tmp_path / "wood"), hidden="true", noIgnore="true", **options).load()
    assert rows(asked) == rows(scan_files(spark, str(tmp_path / "wood"), hidden=True, no_ignore=True, **globs))
    for condition in ("size > 4 and ext = 'py'", "rel_path like 'd1/%'", "rel_path in ('top.py', 'd0/e0/f1.py')", "ext is null or size = 3", "path like '%f1.py' and size between 2 and 6"):
        found = read_tree(spark, str(tmp_path / "wood"), condition, partitions=str(partitions))
        assert rows(found) == rows(source.where(condition)) == rows(scanned.where(condition)), condition


def test_tree_source_pushes_filters(spark, tmp_path):
    wood(tmp_path / "wood")
    found = read_tree(spark, str(tmp_path / "wood"), "size > 4 and ext = 'py'")
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert re.search(r"PushedFilters: \[.*GreaterThan\(size,4\)", plan) and "Condition" not in plan, plan
    walk = _Walk({"path": str(tmp_path / "wood")})
    walk.tests = []
    assert walk._enters(f"{walk.root}/d1")
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    walk.tests = [("rel_path", StringStartsWith, "d1/xe")]
    assert walk._enters(f"{walk.root}/d1") and walk._enters(f"{walk.root}/d1/xe1") and not walk._enters(f"{walk.root}/d2")
    walk.tests = [("rel_path", EqualTo, "d1/xe1/f1.py")]
    assert walk._enters(f"{walk.root}/d1/xe1") and not walk._enters(f"{walk.root}/d1/other")


def test_rules_travel_by_reference(spark, tmp_path):
    """A directory row names the ignore files above it; their text is read where it is needed."""
    from tokengrove.sources.files import Rules, rules_above

    make(tmp_path, {"a/.gitignore": b"x" * 5000 + b"\n*.o\n", "a/b/.ignore": b"!k.o\n", "a/b/c/f": b"1"})
    known = {}
    top = Rules("[]", str(tmp_path / "a"), [".gitignore", ".ignore"], known)
    below = Rules(top.carried, str(tmp_path / "a/b"), [".gitignore", ".ignore"], known)
    assert len(below.carried) < 300 and "xxx" not in below.carried
    deep = Rules(below.carried, str(tmp_path / "a/b/c"), [".gitignore", ".ignore"], known)
    assert deep.ignored(str(tmp_path / "a/b/c/m.o"), False) and not deep.ignored(str(tmp_path / "a/b/c/k.o"), False)
    assert sum(v is not None for v in known.values()) == 2
    # Above a root, .gitignore files count up to where the repository is.
    assert rules_above(str(tmp_path / "a/b/c"), [".gitignore"]) == "[]"
    os.makedirs(tmp_path / "a/.git")
    assert str(tmp_path / "a") in rules_above(str(tmp_path / "a/b/c"), [".gitignore"])
    make(tmp_path, {"a/b/c/g.o": b"1"})
    assert {r.rel_path for r in list_files(spark, str(tmp_path / "a/b/c")).collect()} == {"f", "g.o"} - {"g.o"}


def test_stream_follows_a_tree(spark, tmp_path):
    root, table = tmp_path / "grove", str(tmp_path / "cache")
    make(root, {"a.py": b"one", "d/b.md": b"two", "d/c.md": b"three", "away": b"x"})

    def run():
        time.sleep(3 * SETTLED_US / 1e6)
        scan_stream(spark, str(root), table, str(tmp_path / "state")).awaitTermination()
        found = current_cache(spark, table)
        batch = scan_files(spark, str(root))
        rows = lambda df: sorted((r.rel_path, r.size, r.mtime_us, r.content, r.tokens) for r in df.collect())
        assert rows(found) == rows(batch)
        return {r.rel_path: r.content for r in found.collect()}

    assert len(run()) == 4
    make(root, {"a.py": b"changed", "d/new/e": b"four", ".hid": b"h"})
    os.remove(root / "d/c.md")
    os.utime(root / "away", (1, 1))
    os.rename(root / "away", root / "moved")
    assert run() == {"a.py": "changed", "d/b.md": "two", "d/new/e": "four", "moved": "x"}
    make(root, {"d/c.md": b"three"})
    assert run()["d/c.md"] == "three"
    assert len(run()) == 5


@pytest.mark.parametrize("name", ["scan_cached", "scan_files", "scan_files_hidden", "scan_globs", "scan_ignored", "scan_source", "scan_stream"])
def test_trees_stand_on_disk_in_waves(spark, small, tmp_path, monkeypatch, name):
    """The most bytes that stand at once are a share of the tree, none are left, and the rows are those of one wave."""
    whole = sorted(map(tuple, QUERIES[name](spark, small).collect()), key=str)
    stood = []

    def kept(rows, folder, clear=scanning.clear):
        stood.append(sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names))
        clear(rows, folder)
        left.extend(f for at, _, names in os.walk(folder) for f in names if f not in (".gitignore", ".ignore"))

    left: list[str] = []
    monkeypatch.setattr(scanning, "clear", kept)
    monkeypatch.setattr(scanning, "WAVE_BYTES", 8 << 20)
    monkeypatch.setattr(scanning, "work_dir", lambda spark, label: str(tmp_path / f"{label}-{len(os.listdir(tmp_path))}"))
    waved = sorted(map(tuple, QUERIES[name](spark, small).collect()), key=str)
    assert waved == whole and not left
    assert len(stood) > 2 and max(stood) < 16 << 20


def test_a_repeated_text_leaves_the_jvm_once(spark, tmp_path):
    rows = [("r", "a/long", bytearray(b"ab\n"), 400), ("r", "one", bytearray(b"x"), 1), ("r", "none", bytearray(b""), 400)]
    files = spark.createDataFrame(rows, "repo string, rel_path string, content binary, times int")
    scanning.lay_out(files, str(tmp_path))
    assert {p: (tmp_path / "r" / p).read_bytes() for p in ("a/long", "one", "none")} == {"a/long": b"ab\n" * 400, "one": b"x", "none": b""}
    scanning.lay_out(files.drop("times"), str(tmp_path))
    assert (tmp_path / "r/a/long").read_bytes() == b"ab\n"


def test_a_small_tree_is_listed_in_one_round(spark, tmp_path, monkeypatch):
    """Rounds cost a job each; how many entries a task lists at once changes their number, not the rows."""
    wood(tmp_path / "wood")
    os.symlink(tmp_path / "wood", tmp_path / "wood" / "d0" / "loop")
    rounds = []
    monkeypatch.setattr(files_source, "cut", lambda df: rounds.append(1) or cut(df))
    found = {}
    for together in (4096, 3, 1):
        monkeypatch.setattr(files_source, "_TOGETHER", together)
        rounds.clear()
        rows = list_files(spark, str(tmp_path / "wood"), hidden=True, follow_symlinks=True).collect()
        found[together] = len(rounds), sorted(map(tuple, rows), key=str)
    assert found[4096][0] == 1 < found[3][0] <= found[1][0]
    assert found[4096][1] == found[3][1] == found[1][1] and len(rows) > 30


@pytest.mark.parametrize("name", ["scan_files_hidden", "scan_ignored", "scan_source"])
def test_waves_leave_no_directories(spark, small, tmp_path, monkeypatch, name):
    monkeypatch.setattr(scanning, "work_dir", lambda spark, label: str(tmp_path / f"{label}-{len(os.listdir(tmp_path))}"))
    assert QUERIES[name](spark, small).count()
    assert not [d for d in os.listdir(tmp_path) if d.startswith("tree-") and d.split("-")[1].isdigit()]


def test_few_directories_are_listed_in_few_tasks(spark, tmp_path, monkeypatch):
    wood(tmp_path / "wood")
    tasks = []
    monkeypatch.setattr(files_source, "cut", lambda df: tasks.append(df.rdd.getNumPartitions()) or cut(df))
    monkeypatch.setattr(files_source, "_width", lambda _: 4)
    assert list_files(spark, str(tmp_path / "wood")).count() and tasks == [1]
    tasks.clear()
    monkeypatch.setattr(files_source, "_TOGETHER", 1)
    assert list_files(spark, str(tmp_path / "wood")).count() and tasks[:2] == [1, 4] and max(tasks) == 4


@pytest.mark.parametrize("name", ["scan_ignored", "scan_source"])
def test_a_wave_is_laid_out_and_removed_at_once(spark, small, monkeypatch, name):
    """Ignore files go with the wave's files, all of them go again, and no wave adds a table to the plan."""
    calls = []
    for step in ("lay_out", "clear"):
        monkeypatch.setattr(scanning, step, lambda rows, folder, step=step, do=getattr(scanning, step): (calls.append((step, folder)), do(rows, folder)))
    monkeypatch.setattr(scanning, "WAVE_BYTES", 8 << 20)
    found = QUERIES[name](spark, small)
    assert found.count() and found._jdf.queryExecution().analyzed().collectLeaves().size() == 1
    assert len(calls) == len(set(calls)) > 2 and not any(os.path.exists(local_path(folder)) for _, folder in calls)


def test_a_stream_frees_its_copy_of_a_batch(spark, tmp_path, monkeypatch):
    make(tmp_path / "grove", {f"d{i}/f{i}": b"a long text " * 20_000 for i in range(3)})
    monkeypatch.setattr(incremental, "work_dir", lambda spark, label: str(tmp_path / f"work-{label}"))
    table = str(tmp_path / "cache")
    time.sleep(3 * SETTLED_US / 1e6)
    scan_stream(spark, str(tmp_path / "grove"), table, str(tmp_path / "state")).awaitTermination()
    assert {r.rel_path: len(r.content) for r in current_cache(spark, table).collect()} == {f"d{i}/f{i}": 240_000 for i in range(3)}
    assert sum(os.path.getsize(p) for p in (tmp_path / "work-batch").glob("*")) < 1_000
    discard(spark, table)
    assert sum(os.path.getsize(p) for p in (tmp_path / "cache").rglob("*") if p.is_file()) < 1_000


def test_files_that_arrive_once_are_told_by_name(spark, tmp_path):
    rows = [("r", "once", 1, 1, "o", 1), ("r", "two", 1, 2, "old", 1), ("r", "two", 2, 1, "new", 1), ("r", "same", 1, 1, "s", 1), ("r", "same", 1, 1, "s", 1)]
    rows += [("r", "part", None, 1, "x", 1), ("r", "part", 3, 1, "p", 1), ("r", "null", None, 1, "n", 1), (None, "null", 1, 1, "n", 1)]
    spark.createDataFrame(rows, LISTING).write.parquet(str(tmp_path / "batch"))
    batch = spark.read.schema(LISTING).parquet(str(tmp_path / "batch"))
    found = sorted(map(tuple, incremental._newest_of_written(batch).collect()))
    assert found == sorted(map(tuple, incremental._newest(batch).collect()))
    assert [(r[1], r[4]) for r in found] == [("once", "o"), ("part", "p"), ("same", "s"), ("two", "new")]
