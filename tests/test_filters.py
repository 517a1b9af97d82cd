import random
import re

from hypothesis import given, settings, strategies as st
import pytest
from pyspark.sql import functions as F

from tokengrove.functions.globs import compiled_rules, glob_to_regex, ignore_line_to_rule
from tokengrove.functions.paths import ancestors, extension_of, parent_of, path_label, strip_root
from tokengrove.operators import filters, ignore, selection
from tokengrove.plans.lineage import cut

# A house: rooms on floors, each with a list and a drawing; the attic is nested deeper.
ROOMS = ["kitchen", "hall", "study"]
TREE = [f"floor{n}/{room}{end}" for n in (1, 2) for room in ROOMS for end in (".csv", ".svg")]
TREE += ["attic/old/boxes.csv", "README", "Floor1/kitchen.csv", "plan.svg"]


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame([("r", p) for p in TREE], "repo string, rel_path string").cache()


def kept(tree, include=(), exclude=(), priority=False):
    rows = filters.filter_globs(tree, list(include), list(exclude), priority).collect()
    return {r.rel_path for r in rows}


def ends(*tails):
    return {p for p in TREE if p.endswith(tails)}


def test_tree_cases(tree):
    everything = set(TREE)
    for priority in (False, True):
        assert kept(tree, priority=priority) == everything
        assert kept(tree, ["README"], priority=priority) == {"README"}
        assert kept(tree, ["*"], priority=priority) == everything
    # One star crosses folders; case counts.
    assert kept(tree, ["floor1*"]) == {p for p in TREE if p.startswith("floor1/")}
    assert kept(tree, ["**/KITCHEN.csv"]) == set()
    assert kept(tree, ["attic/**"]) == {"attic/old/boxes.csv"}
    assert kept(tree, ["{hall,plan}.svg", "**/hall.csv"]) == {"plan.svg"} | ends("hall.csv")
    assert kept(tree, exclude=["**/old/**", "*.svg"]) == ends(".csv", "README") - {"attic/old/boxes.csv"}
    # Both sides match the studies: the priority decides; without includes it lifts the excludes.
    studies = ends("study.csv", "study.svg")
    assert kept(tree, ["**/study.*"], ["floor2/**"], False) == {p for p in studies if "floor2" not in p}
    assert kept(tree, ["**/study.*"], ["floor2/**"], True) == studies
    assert kept(tree, exclude=["floor?/**"], priority=False) == {p for p in TREE if not p.startswith("floor")}
    assert kept(tree, exclude=["floor?/**"], priority=True) == everything


def test_bad_patterns_raise():
    for bad in ("[a", "{a,b", "a}", "a\\", "[z-a]"):
        with pytest.raises(ValueError):
            glob_to_regex(bad)


def glob_matches(pattern: str, text: str) -> bool:
    """Naive matcher over the part of the dialect the strategy below draws."""
    if not pattern:
        return not text
    if pattern.startswith("**/"):
        rest = pattern[3:]
        return any(
            glob_matches(rest, text[i:]) for i in range(len(text) + 1) if i == 0 or text[i - 1] == "/"
        )
    if pattern[0] == "*":
        return any(glob_matches(pattern[1:], text[i:]) for i in range(len(text) + 1))
    if pattern[0] == "?":
        return bool(text) and glob_matches(pattern[1:], text[1:])
    if pattern[0] == "[":
        end = pattern.index("]")
        inside = pattern[1:end]
        hit = bool(text) and ((text[0] in inside[1:]) is False if inside[0] == "!" else text[0] in inside)
        return hit and glob_matches(pattern[end + 1 :], text[1:])
    if pattern[0] == "{":
        end = pattern.index("}")
        return any(
            glob_matches(option + pattern[end + 1 :], text) for option in pattern[1:end].split(",")
        )
    return text[:1] == pattern[0] and glob_matches(pattern[1:], text[1:])


piece = st.sampled_from(["a", "b", "/", ".", "*", "?", "[ab]", "[!a]", "{a,b/}", "+", "("])


@settings(max_examples=400, deadline=None)
@given(
    st.booleans(),
    st.lists(piece, max_size=6).map("".join),
    st.text(alphabet="ab/.+(", max_size=8),
)
def test_globs_mean_what_a_naive_matcher_says(lead, body, text):
    if "**" in body or body.startswith("/"):
        return
    pattern = ("**/" if lead and body else "") + body
    expected = glob_matches(pattern, text)
    if lead and body and text.startswith("/"):
        return  # a leading slash may or may not count as a directory
    assert bool(re.fullmatch("(?s)" + glob_to_regex(pattern), text)) == expected


def test_decision_properties(spark):
    globs = ["*.py", "a/**", "**/b*", "?", "[ab]/*", "{a,b}.py"]
    rng = random.Random(2)
    paths = sorted({"".join(rng.choices("ab/.py", k=rng.randint(1, 7))).lstrip("/") or "a" for _ in range(120)})
    cases = [
        (rng.sample(globs, rng.randint(0, 2)), rng.sample(globs, rng.randint(0, 2)), rng.random() < 0.5)
        for _ in range(40)
    ]
    cases += [([g], [g], p) for g in globs for p in (True, False)] + [([], [], False), ([], globs, True)]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    columns = [filters.glob_decision(F.col("p"), i, e, x).alias(f"c{n}") for n, (i, e, x) in enumerate(cases)]
    for row in df.select("p", *columns).collect():
        hit = lambda gs: any(re.fullmatch("(?s)" + glob_to_regex(g), row.p) for g in gs)
        for n, (include, exclude, priority) in enumerate(cases):
            if not include and not exclude:
                expected = True
            elif include and not hit(include):
                expected = False
            else:
                expected = priority or not hit(exclude)
            assert row[f"c{n}"] == expected, (row.p, include, exclude, priority)


def test_sizes_and_encoding(spark):
    rows = [("a", b""), ("b", b"x"), ("c", b"x" * 1048576), ("d", b"x" * 1048577), ("e", b"\xff\xfe"), ("f", b"a\0b")]
    df = spark.createDataFrame(rows, "rel_path string, content binary").withColumn(
        "size", F.octet_length("content").cast("bigint")
    )
    good = filters.utf8_guard(filters.size_guard(df)).collect()
    assert sorted(r.rel_path for r in good) == ["b", "c", "f"]
    assert {r.rel_path: r.content for r in good}["f"] == "a\0b"


def test_paths(spark):
    names = [("a.tar.gz", "gz"), (".env", None), ("a.", ""), ("noext", None), ("x.d/y", None), ("q/.a.b", "b"), ("__init__.py", "py")]
    df = spark.createDataFrame(names, "p string, e string")
    got = df.select("p", "e", extension_of(F.col("p")).alias("x"), parent_of(F.col("p")).alias("d")).collect()
    assert all(r.x == r.e for r in got)
    assert {r.p: r.d for r in got}["q/.a.b"] == "q" and {r.p: r.d for r in got}["noext"] == ""
    one = spark.createDataFrame([("a/b/c", "/r/x\\y", "/r")], "p string, f string, r string").select(
        ancestors(F.col("p")).alias("all"),
        ancestors(F.col("p"), root=False, itself=False).alias("mid"),
        ancestors(F.lit("")).alias("root"),
        strip_root(F.col("f"), F.col("r")).alias("rel"),
        strip_root(F.lit("/rx/y"), F.col("r")).alias("out"),
        path_label(F.lit("/a/b/")).alias("lab"),
        path_label(F.lit("/"), "cwd").alias("lab0"),
    ).first()
    assert one["all"] == ["", "a", "a/b", "a/b/c"] and one.mid == ["a", "a/b"] and one.root == [""]
    assert one.rel == "x/y" and one.out == "/rx/y" and one.lab == "b" and one.lab0 == "cwd"


def test_ignore_rules(spark):
    texts = {
        ".gitignore": "*.log\n!keep.log\nbuild/\n/top.txt\n# c\n\ndocs/*.md\na/**/z\n\\#odd\n",
        "src/.gitignore": "!special.log\n!build/x.rs\n*.tmp\n",
    }
    paths = {
        "x.log": False, "keep.log": True, "src/special.log": True, "src/a.log": False,
        "build/x.rs": False, "src/build/x.rs": False, "build": True, "top.txt": False,
        "src/top.txt": True, "docs/a.md": False, "docs/in/a.md": True, "a/z": False,
        "a/b/c/z": False, "src/t.tmp": False, "t.tmp": True, "#odd": False, "a/zz": True,
        "docs/keep.log/x": True,
    }
    paths.pop("build")
    files = spark.createDataFrame([("r", p) for p in paths], "repo string, rel_path string")
    sources = spark.createDataFrame([("r", p, t) for p, t in texts.items()], "repo string, rel_path string, content string")
    rules = ignore.read_rules(sources)
    got = {r.rel_path for r in ignore.drop_ignored(files, rules).collect()}
    assert got == {p for p, keep in paths.items() if keep}
    assert ignore.drop_ignored(files, rules, no_ignore=True).count() == len(paths)
    assert ignore_line_to_rule("trail   ")[0] == ignore_line_to_rule("trail")[0]
    assert ignore_line_to_rule("!x/")[1:] == (True, True)


def exchanged(df):
    """Columns of the rows that a plan shuffles, one set per exchange."""
    session = df.sparkSession
    session.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = session._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    finally:
        session.conf.set("spark.sql.adaptive.enabled", "true")
    return [set(re.findall(r"(\w+)#\d+", m)) for m in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)]


RULES = ["*.log", "!keep*.log", "/out/", "a/**/b", "[x-z]?.md", "!y1.md", "tmp/", "!tmp/keep", "# no", "", "deep/*/c"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(RULES), max_size=8), st.lists(st.sampled_from(["a.log", "keep1.log", "out", "a/q/b", "y1.md", "tmp", "tmp/keep", "deep/x/c", "z.log/out"]), max_size=6), st.booleans())
def test_fused_rules_agree_with_single_ones(lines, paths, is_dir):
    fused = compiled_rules(lines)
    single = [r for r in map(ignore_line_to_rule, lines) if r is not None]
    for path in paths:
        last = [not negated for regex, negated, dirs in single if (is_dir or not dirs) and re.search(regex.replace(r"\z", r"\Z"), path)]
        assert fused.ignored(path, is_dir) == (last[-1] if last else None)


@pytest.fixture(scope="module")
def contents(spark):
    rows = [("r" if i % 3 else "s", f"{d}/f{i}.{e}", e, f"body {i}") for i, (d, e) in enumerate((d, e) for d in ("a", "a/b", "a/b/c", "x", "x/y") for e in ("py", "md", "o"))]
    return cut(spark.createDataFrame(rows, "repo string, rel_path string, ext string, content string"))


def test_rules_leave_contents_in_place(spark, contents, monkeypatch):
    lines = [("r", "", "*.o\nx/\n"), ("s", "", "a/b/\n!a/b/\n"), ("s", "a/b", "c/\n"), ("r", "a", "*.md\n")]
    ignore_files = spark.createDataFrame([(r, f"{d}/.gitignore".lstrip("/"), t) for r, d, t in lines], "repo string, rel_path string, content string")
    rules = ignore.read_rules(ignore_files)
    kept = ignore.drop_ignored(contents, rules)
    want = {(r.repo, r.rel_path) for r in kept.collect()}
    assert all(not (r == "r" and (p.endswith(".o") or p.startswith("x/"))) for r, p in want) and len(want) == 4
    assert not any(p.startswith("a/b/c/") for r, p in want if r == "s")
    assert not [c for c in exchanged(kept) if "content" in c]
    monkeypatch.setattr(ignore, "RULE_BYTES", 0)  # rules join on their digest
    assert {(r.repo, r.rel_path) for r in ignore.drop_ignored(contents, rules).collect()} == want


def test_selections_leave_contents_in_place(spark, contents):
    rows = [("r", "directory", "A/b/"), ("r", "extension", "py"), ("r", "extension", "md"), ("s", "directory", "x"), ("s", "directory", "a/b/c")]
    table = spark.createDataFrame(rows, "repo string, kind string, value string")
    kept = selection.select_by_table(contents, table)
    got = {(r.repo, r.rel_path) for r in kept.collect()}
    want = {
        (r.repo, r.rel_path)
        for r in contents.collect()
        if (r.rel_path.startswith("a/b/") and r.ext != "o" if r.repo == "r" else r.rel_path.startswith(("x/", "a/b/c/")))
    }
    assert got == want and not [c for c in exchanged(kept) if "content" in c]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {(r.repo, r.rel_path) for r in selection.select_by_table(contents, table).collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_nearest_rows_decide(spark, contents):
    rows = [("r", "a", True), ("r", "/a/b/", False), ("r", "a/b/c", True), ("s", "", True), ("s", "x", False), ("s", "x", True), ("r", "x", None)]
    table = spark.createDataFrame(rows, "repo string, path string, selected boolean")
    got = {(r.repo, r.rel_path): r.selected for r in selection.flag_by_selection(contents, table).collect()}
    for (repo, path), chosen in got.items():
        folder = path.rpartition("/")[0]
        assert chosen == (folder in ("a", "a/b/c") if repo == "r" else not path.startswith("x/")), (repo, path)
