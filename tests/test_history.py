import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokengrove.functions.lines import common_lines
from tokengrove.operators import vcs
from tokengrove.plans.lineage import cut


def walk(parents, head):
    seen, stack = set(), [head]
    while stack:
        c = stack.pop()
        if c not in seen and c in parents:
            seen.add(c)
            stack += parents[c]
    return seen


def run(spark, graphs):
    """graphs: repo -> (parents, refs, requests)."""
    commits = [(r, c, p, i, f"s{c}") for r, (g, _, _) in graphs.items() for i, (c, p) in enumerate(g.items())]
    refs = [(r, b, c) for r, (_, h, _) in graphs.items() for b, c in h.items()]
    asks = [(r, a, b) for r, (_, _, q) in graphs.items() for a, b in q]
    out = vcs.commit_range(
        spark.createDataFrame(commits, "repo string, commit string, parents array<string>, ts bigint, summary string"),
        spark.createDataFrame(refs, "repo string, branch string, commit string"),
        spark.createDataFrame(asks, "repo string, branch1 string, branch2 string"),
    )
    got = {}
    for r in out.collect():
        got.setdefault((r.repo, r.branch1, r.branch2), {})[r.seq] = r.commit
    return {k: [v[i] for i in sorted(v)] for k, v in got.items()}


@pytest.fixture(params=["walked", "chains"])
def how(request, monkeypatch):
    """Small histories walked as a group, or all by chains."""
    if request.param == "chains":
        monkeypatch.setattr(vcs, "SMALL_WALK", 0)


def test_random_graphs(spark, how):
    rng = random.Random(11)
    graphs = {}
    for n in range(30):
        size = rng.randint(1, 40)
        g = {}
        for i in range(size):
            roots = i == 0 or rng.random() < 0.05
            span = range(max(0, i - 4), i)
            g[f"{i:03d}"] = [] if roots else [f"{p:03d}" for p in sorted(set(rng.choices(span, k=rng.choice([1, 1, 1, 2, 3]))))]
        names = list(g)
        heads = {b: rng.choice(names) for b in ("a", "b", "c")}
        graphs[f"r{n}"] = (g, heads, [("a", "b"), ("b", "c"), ("a", "gone")])
    got = run(spark, graphs)
    for repo, (g, heads, asks) in graphs.items():
        for a, b in asks:
            expected = sorted(walk(g, heads[b]) - walk(g, heads[a])) if b in heads else []
            assert got.get((repo, a, b), []) == expected, (repo, a, b)


def test_long_chain_and_shallow_history(spark, how):
    chain = {f"{i:04d}": [f"{i - 1:04d}"] for i in range(700)}  # 0000 names a parent that is not there
    got = run(spark, {"r": (chain, {"m": "0003", "d": "0699"}, [("m", "d"), ("d", "m")])})
    assert got == {("r", "m", "d"): [f"{i:04d}" for i in range(4, 700)]}


def test_many_merges_take_few_rounds(spark):
    """A main line with a branch of two commits merged at every step, and nested branches."""
    rows, n = [("r", "m00000", [])], 2000
    for i in range(1, n):
        old, back = f"m{i - 1:05d}", f"m{max(0, i - 3):05d}"
        rows += [("r", f"a{i:05d}", [back]), ("r", f"b{i:05d}", [f"a{i:05d}"]), ("r", f"m{i:05d}", [old, f"b{i:05d}"])]
    rows += [("r", f"n{k}", [f"n{k - 1}" if k else "m00005"]) for k in range(5)] + [("r", "top", ["n4", "m00010"])]
    commits = spark.createDataFrame(rows, "repo string, commit string, parents array<string>")
    places, cross = vcs._chains(commits)
    main = {r.commit: r.pos for r in places.where("chain = 'm01999'").collect()}
    assert all(main[f"m{i:05d}"] == i for i in range(n))
    heads = places.where(F.col("commit").isin("m01999", "m01000", "top")).select(
        "repo", F.col("commit").alias("head"), "chain", F.col("pos").alias("limit")
    )
    reach, rounds = vcs._reached(heads, cross)
    assert rounds <= 3
    whole = reach.join(places, ["repo", "chain"]).where("pos <= limit").groupBy("head").count()
    assert {r.head: r["count"] for r in whole.collect()} == {"m01999": 3 * n - 2, "m01000": 3001, "top": 3 * 10 + 1 + 6}


def test_cycle_is_reported(spark, how):
    with pytest.raises(ValueError):
        run(spark, {"r": ({"a": ["b"], "b": ["a"]}, {"m": "a"}, [("m", "m")])})


def test_log_lines(spark):
    commits = spark.createDataFrame(
        [("r", "c0ffee0000", [], 0, "root"), ("r", "1111111aaa", ["c0ffee0000"], 1, "Teach the parser new words"), ("r", "2222222bbb", ["1111111aaa"], 2, None)],
        "repo string, commit string, parents array<string>, ts bigint, summary string",
    )
    refs = spark.createDataFrame([("r", "trunk", "c0ffee0000"), ("r", "feature", "2222222bbb")], "repo string, branch string, commit string")
    ask = spark.createDataFrame([("r", "trunk", "feature")], "repo string, branch1 string, branch2 string")
    rows = vcs.log_stream(vcs.commit_range(commits, refs, ask)).orderBy("key").collect()
    assert "".join(r.text for r in rows) == "1111111 - Teach the parser new words\n2222222 - No commit message\n"
    assert vcs.missing_branches(spark.createDataFrame([("r", "trunk", "x")], "repo string, branch1 string, branch2 string"), refs).collect()[0].branch == "x"


# ── patches ──────────────────────────────────────────────────────────────────


def bare(text):
    return re.sub(r"[ \t\r\f\v]+", "", text or "").removesuffix("\n")


def changed(patch):
    return sum(origin in "+-" for origin, _ in patch)


def test_patches_apply():
    rng = random.Random(3)
    for _ in range(600):
        old = [rng.choice(["a", "b", " c", "", "d  d"]) for _ in range(rng.randint(0, 30))]
        new = list(old)
        for _ in range(rng.randint(0, 6)):
            k = rng.randint(0, len(new))
            new[k : k + rng.randint(0, 3)] = [rng.choice(["x", "a ", "", "y"]) for _ in range(rng.randint(0, 3))]
        a, b = "\n".join(old) + "\n" * bool(old), "\n".join(new) + "\n" * bool(new)
        assert bare(vcs.apply_patch(a, list(vcs.file_patch("p", a, b)))) == bare(b)


@pytest.mark.parametrize("ends", [("", ""), ("\n", ""), ("", "\n"), ("\n", "\n")])
def test_patches_restore_the_last_newline(ends):
    old, new = "one\ntwo\nthree" + ends[0], "zero\none\ntwo\nfour" + ends[1]
    for a, b in ((old, new), (None, new), (new, None), (old, "")):
        assert vcs.apply_patch(a, list(vcs.file_patch("p", a, b))) == b


def test_patches_are_as_short_as_can_be():
    rng = random.Random(8)
    for size, pool, added in ((2100, 3, 1), (260, 3, 2), (5000, 2, 4)):
        old = [f"v{rng.randrange(pool)}" for _ in range(size)]
        new = list(old)
        for n in range(added):
            new.insert(rng.randrange(len(new)), f"added {n}")
        a, b = "\n".join(old) + "\n", "\n".join(new) + "\n"
        patch = list(vcs.file_patch("p", a, b))
        assert changed(patch) == added
        assert vcs.apply_patch(a, patch) == b


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b):
            corner, row[j + 1] = row[j + 1], corner + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_lines_are_the_longest():
    rng = random.Random(1)
    for _ in range(500):
        pool = rng.choice([1, 2, 3, 8])
        a, b = ([str(rng.randrange(pool)) for _ in range(rng.randrange(40))] for _ in range(2))
        pairs = common_lines(a, b)
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


@pytest.mark.parametrize("kind", ["few kinds", "shuffled", "all equal"])
def test_large_patches_stay_cheap(kind):
    rng = random.Random(4)
    n = 50_000
    pool = {"few kinds": 300, "shuffled": n, "all equal": 1}[kind]
    old = [f"l{rng.randrange(pool)}" for _ in range(n)]
    new = rng.sample(old, n) if kind == "shuffled" else old[:50] + ["x"] + [f"l{rng.randrange(pool)}" for _ in range(n)]
    a, b = "\n".join(old) + "\n", "\n".join(new) + "\n"
    start = time.monotonic()
    assert vcs.apply_patch(a, list(vcs.file_patch("p", a, b))) == b
    assert time.monotonic() - start < 60


def test_hunk_headers():
    patch = list(vcs.file_patch("p", "only\n", "other\n"))
    assert patch[3] == ("H", "@@ -1 +1 @@")
    assert list(vcs.file_patch("p", None, "x"))[1:] == [
        ("F", "new file mode 100644"), ("F", "--- /dev/null"), ("F", "+++ b/p"), ("H", "@@ -0,0 +1 @@"), ("+", "x"),
        ("N", "\\ No newline at end of file"),
    ]


def test_snapshots(spark):
    df = lambda rows: spark.createDataFrame([("r", *x) for x in rows], "repo string, rel_path string, content string")
    old = df([("same", "a\nb\n"), ("space", "a b\n"), ("eof", "x"), ("mod", "1\n2\n"), ("gone", "z"), ("blank", "a\nb")])
    new = df([("same", "a\nb\n"), ("space", "a  b \n"), ("eof", "x\n"), ("mod", "1\n3\n"), ("new", "n\n"), ("blank", "a\n\nb")])
    got = {r.rel_path: r.status for r in vcs.snapshot_diff(old, new).collect()}
    assert got == {"mod": "M", "gone": "D", "new": "A", "blank": "M"}
    lines = [(r.origin, r.text) for r in vcs.patch_lines(old, new).where("rel_path = 'mod'").orderBy("seq").collect()]
    assert lines[-4:] == [("H", "@@ -1,2 +1,2 @@"), (" ", "1"), ("-", "2"), ("+", "3")]
    heads = [r.text for r in vcs.patch_lines(old, new).where("origin = 'F' and rel_path in ('new', 'gone')").collect()]
    assert "--- /dev/null" in heads and "+++ /dev/null" in heads


def test_diff_stream(spark):
    df = lambda t: spark.createDataFrame([("r", "notes/plan.md", t)], "repo string, rel_path string, content string")
    rows = vcs.diff_stream(vcs.patch_lines(df("buy milk\n"), df("buy bread\n"))).orderBy("key").collect()
    assert "".join(r.text for r in rows).endswith("@@ -1 +1 @@\n-buy milk\n+buy bread\n")


def test_hash_trees(spark):
    """One changed file compares one path of directories; the result is that of comparing all files."""
    rows = [("r", f"a{i}/b{j}/c{k}/f{n}", f"{i}{j}{k}{n}\n") for i in range(4) for j in range(3) for k in range(3) for n in range(3)]
    schema = "repo string, rel_path string, content string"
    old = spark.createDataFrame(rows, schema)
    one = spark.createDataFrame([(r, p, "new\n" if p == "a2/b1/c0/f2" else t) for r, p, t in rows], schema)
    trees = [cut(vcs.snapshot_tree(t)) for t in (old, one)]
    levels = [sorted((r.node, r.status) for r in level.collect()) for level in vcs.differing_levels(*trees)]
    assert levels == [[(p, "M")] for p in ("", "a2", "a2/b1", "a2/b1/c0", "a2/b1/c0/f2")]
    assert vcs.tree_diff(trees[0], trees[0]).count() == 0
    rng = random.Random(5)
    many = [(r, p.replace("a3", "z") if rng.random() < 0.2 else p, t if rng.random() < 0.8 else t + "x") for r, p, t in rows if rng.random() < 0.9]
    many += [("r", "a0/b0/c0/f0/now/a/folder", "1"), ("s", "only", "2")]
    many = spark.createDataFrame([m for m in many if m[1] != "a0/b0/c0/f0"], schema)
    key = lambda df: sorted(tuple(r) for r in df.select("repo", "rel_path", "status").collect())
    assert key(vcs.tree_diff(trees[0], cut(vcs.snapshot_tree(many)))) == key(vcs.snapshot_diff(old, many))


def test_patches_apply_file_by_file(monkeypatch):
    """What is applied leaves before the batch is through, and one patch at a time is Python objects."""
    monkeypatch.setattr(vcs, "FLUSH_BYTES", 3)
    line = [{"seq": 0, "origin": "H", "text": "@@ -1 +1 @@"}, {"seq": 1, "origin": "-", "text": "a"}, {"seq": 2, "origin": "+", "text": "b"}]
    rows = [{"repo": "r", "rel_path": str(i), "patch": line, "old": "a\nc\n"} for i in range(4)]
    got = list(vcs._apply_groups(iter([pa.RecordBatch.from_pylist(rows)])))
    assert [b.num_rows for b in got] == [1] * 4
    assert [r["content"] for b in got for r in b.to_pylist()] == ["b\nc\n"] * 4


def test_digests_leave_out_white_space_without_patterns(spark):
    """Digests are those of the pattern they stand in for; no text goes through a pattern, in Spark or Python."""
    texts = ["", "\n", "\n\n", "a", "a\n", "a \n", "a\n ", "a\n\n", " \t a\r\n b\f\v\n", "\u00a0a\u2003b ", "é \n\tü", "x\n \n", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    old = F.sha2(F.regexp_replace(F.regexp_replace("content", r"[ \t\r\f\x0B]+", ""), r"\n\z", ""), 256)
    new = vcs._digest(F.col("content"))
    assert "regexp" not in df.select(new)._jdf.queryExecution().analyzed().toString()
    rows = df.select("i", old.alias("old"), new.alias("new")).collect()
    assert [r.new for r in rows] == [r.old for r in rows]
    white = re.compile(r"[ \t\r\f\v]+")
    for text in texts:
        lines = vcs._split(text)
        assert vcs._bare(text, len(lines)) == [white.sub("", line) for line in lines]
