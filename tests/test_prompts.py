import json
import re

import pytest
from pyspark.sql import functions as F

from tokengrove.catalog import load
from tokengrove.functions.tokens import bpe_tokens, register_tokenizer
from tokengrove.operators import counting, render, templates, variables, vcs
from tokengrove.operators.counting import prompt_tokens
from tokengrove.plans import assemble as assembling
from tokengrove.plans.assemble import assemble
from tokengrove.sources.sinks import read_prompts, write_prompts

QUERIES = load()[0]


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        ("r", "/c/r/a.py", "a.py", "py", 6, 2, "x = 1\n", 2),
        ("r", "/c/r/b/c.rs", "b/c.rs", "rs", 4, 1, "fn()", 1),
        ("r", "/c/r/b/none", "b/none", None, 0, None, None, None),
        ("s", "/c/s/z", "z", None, 1, 5, "q", 1),
    ]
    return spark.createDataFrame(
        rows, "repo string, path string, rel_path string, ext string, size bigint, mtime_us bigint, content string, tokens bigint"
    ).cache()


def prompts(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.repo, r.part)):
        got[r.repo] = got.get(r.repo, "") + r.prompt
    return got


DEFAULT_R = (
    "Project Path: r\n\nSource Tree:\n\n```\nr\n├── a.py\n├── b/c.rs\n└── b/none\n\n```\n\n"
    "`a.py`:\n\n```py\nx = 1\n```\n\n`b/c.rs`:\n\n```rs\nfn()```"
)


def test_default_prompt(files):
    assert prompts(render.render_prompts(files))["r"] == DEFAULT_R


@pytest.mark.parametrize("size", [1, 7, 40, 10**6])
def test_parts_concatenate_to_the_prompt(files, size):
    got = render.render_prompts(files, part_bytes=size)
    assert prompts(got)["r"] == DEFAULT_R
    if size == 7:
        assert got.where("repo = 'r'").count() > 3


ALIKE = {
    "long": "Project {{absolute_code_path}}\n{{source_tree}}\n{{#each files}}\n{{path}}:{{code}}\n{{/each}}\nWhat is asked of {{who}}\n",
    "blank": " \n{{#if who}}  {{/if}} {{source_tree}} \n\t{{#each files}}\n{{path}}:{{code}}\n{{/each}}\n \n",
    "short": "{{source_tree}}{{#each files}}\n{{path}}:{{code}}\n{{/each}}\n",
    "empty": "\n",
    "same": "P {{source_tree}}é{{#each files}}\n{{path}}:{{code}}\n{{/each}}\n.",
    "other": "{{#each files}}{{path}} {{/each}}{{source_tree}}",
}


@pytest.mark.parametrize("size, with_variables", [(7, False), (10**6, True)])
def test_named_templates_are_rendered_as_each_by_itself(spark, files, size, with_variables):
    given = [("r", "who", "someone"), ("s", "source_tree", " own tree\n")]
    variables_ = spark.createDataFrame(given, "repo string, key string, value string") if with_variables else None
    got = render.render_prompts(files, ALIKE, size, variables=variables_)
    assert got.columns == ["repo", "part", "prompt", "template"]
    rows = sorted(map(tuple, got.collect()))
    wanted = []
    for name, body in ALIKE.items():
        wanted += [(*r, name) for r in render.render_prompts(files, body, size, variables=variables_).collect()]
    assert rows == sorted(wanted)


def test_library_shares_its_pieces(spark, monkeypatch, tmp_path):
    """Templates that differ in what they ask write and shuffle the texts of the files once."""
    rows = [(i, f"text {i} " * 50, "en", "src") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    written = []
    monkeypatch.setattr(assembling, "cut", lambda df, plain=assembling.cut: written.append(plain(df)) or written[-1])
    got = QUERIES["render_library"](spark, str(tmp_path))
    held = sum(df.agg(F.sum(F.octet_length("text"))).first()[0] for df in written if "text" in df.columns)
    assert sum(len(r[1]) for r in rows) < held < 2 * sum(len(r[1]) for r in rows)
    assert got.select("template").distinct().count() == got.count() == 7
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES["render_library"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 7 and plan.count("ReusedExchange") == 6


def test_options(files):
    got = prompts(
        render.render_prompts(
            files, "{{#each files}}\n{{path}}|{{code}}|\n{{/each}}\n", absolute=True, line_numbers=True, sort="date-asc"
        )
    )
    assert got["r"] == "/c/r/b/c.rs|```rs\n   1 | fn()\n```|\n/c/r/a.py|```py\n   1 | x = 1\n```|"


def test_blocks_variables_and_trimming(spark, files):
    given = spark.createDataFrame(
        [("r", "goal", "win"), ("r", "git_diff", "mine"), ("s", "blank", " \n ")], "repo string, key string, value string"
    )
    diff = spark.createDataFrame([("r", ["0"], "line\n"), ("s", ["0"], "d\n"), ("s", ["1"], "e\n")], "repo string, key array<string>, text string")
    text = "{{blank}}\n  {{#if goal}}\n  G={{goal}}\n  {{/if}}\n{{#if git_diff}}\nD:{{git_diff}}{{#if goal}}!{{/if}}\n{{/if}}{{blank}}{{missing}}\n\n"
    got = prompts(render.render_prompts(files, text, streams={"git_diff": diff}, variables=given))
    assert got == {"r": "G=win\nD:mine!", "s": "D:d\ne"}
    hidden = "{{#if goal}}{{#if git_diff}}<{{git_diff}}>{{/if}}{{/if}}."
    got = prompts(render.render_prompts(files, hidden, streams={"git_diff": diff}, variables=given.where("key <> 'git_diff'")))
    assert got == {"r": "<line\n>.", "s": "."}
    assert prompts(render.render_prompts(files, "{{ nothing }} \n"))["s"] == ""


def test_library_renders(spark, files):
    given = spark.createDataFrame([("r", k, f"<{k}>") for k in ("instructions", "challenge_name", "challenge_description", "target_url")], "repo string, key string, value string")
    lines = spark.createDataFrame([("r", ["0"], "L\n")], "repo string, key array<string>, text string")
    streams = {k: lines for k in ("git_diff", "git_diff_branch", "git_log_branch")}
    assert len(templates.LIBRARY) == 15
    for name, body in templates.LIBRARY.items():
        got = prompts(render.render_prompts(files, body, streams=streams, variables=given))
        assert "{{" not in got["r"] and "b/c.rs" in got["r"], name
        if name in ("commit", "pull-request"):
            assert "\nL\n" in got["r"] and "\nL\n" not in got.get("s", "")


def test_template_errors():
    for bad in ("{{#each dirs}}{{/each}}", "{{#if x}}", "{{/if}}", "{{#if x}}{{/each}}", "{{> part}}", "{{#if x}}a{{else}}b{{/if}}"):
        with pytest.raises(ValueError):
            templates.parse_template(bad)


def test_placeholders(spark):
    # Names are made by rule: a body names every variable twice, and loops hide theirs.
    names = [f"{kind}_{n}" for kind in ("tone", "reader") for n in range(4)]
    rows = [
        (str(k), "".join(f"<{{{{{n}}}}}|{{{{ {n} }}}}>" for n in names[:k]) + "{{#each files}}{{path}}{{this.code}}{{own}}{{/each}}{{source_tree}}")
        for k in range(1, len(names) + 1)
    ]
    got = {}
    for r in variables.placeholders(spark.createDataFrame(rows, "repo string, body string")).collect():
        got.setdefault(r.repo, []).append(r.key)
    assert {k: sorted(v) for k, v in got.items()} == {str(k): sorted(names[:k]) for k in range(1, len(names) + 1)}


def test_if_on_a_number(spark, files):
    text = "{{#each files}}\n{{#if token_count}}{{path}};{{/if}}\n{{/each}}"
    none = files.withColumn("tokens", F.when(F.col("rel_path") == "a.py", 0).otherwise(F.col("tokens")).cast("bigint"))
    assert "a.py" in prompts(render.render_prompts(files, text))["r"]
    assert prompts(render.render_prompts(none, text))["r"] == "b/c.rs;"


def test_variable_priority(spark):
    order = ["env", "config", "cached", "file", "cli"]
    rows = [("r", s, f"k{i}", s) for i in range(5) for s in order[: i + 1]]
    df = spark.createDataFrame(rows, "repo string, source string, key string, value string")
    assert {r.key: r.value for r in variables.merge_vars(df).collect()} == {f"k{i}": s for i, s in enumerate(order)}
    documented = {r.key: r.value for r in variables.merge_vars(df, variables.DOCUMENTED_PRIORITY).collect()}
    assert documented["k3"] == "env" and documented["k4"] == "cli"


def test_json_and_files_on_disk(spark, files, tmp_path):
    placed = render.placed_prompts(files)
    parts = render.prompt_json(placed, files, "cl100k", part_bytes=20)
    text = {}
    for r in sorted(parts.collect(), key=lambda r: r.part):
        text[r.repo] = text.get(r.repo, "") + r.json
    record = json.loads(text["r"])
    assert record["prompt"] == DEFAULT_R and list(record) == sorted(record)
    assert record["files"] == ["/c/r/a.py", "/c/r/b/c.rs", "/c/r/b/none"]
    assert record["token_count"] == (len(DEFAULT_R.encode()) + 3) // 4
    write_prompts(render.render_prompts(files, part_bytes=50), str(tmp_path / "out"))
    assert prompts(read_prompts(spark, str(tmp_path / "out")))["r"] == DEFAULT_R


@pytest.mark.parametrize("name", ["cl100k", "r50k_base", "o200k_base"])
def test_prompt_tokens_do_not_depend_on_parts(spark, name):
    tok = register_tokenizer(name, ranks={**{bytes([b]): b for b in range(256)}, b"\n\n": 256, b"ab": 257, b"  ": 258, b"\n\n\n": 259, b"''": 260})
    body = "ab ab\n\n\n''ab\n  12''\n\n" * 40 + "''" * 50 + "\n\n\n" * 30 + "7,8;9\n12 345 6\n" * 60 + "xab\nab"
    rows = [("r", f"f{i:02d}", None, body[i:], 1) for i in range(6)]
    df = spark.createDataFrame(rows, "repo string, rel_path string, ext string, content string, tokens bigint").withColumn("path", F.col("rel_path")).withColumn("mtime_us", F.lit(0))
    template = "{{#each files}}{{code}}{{/each}}"
    counts = {
        size: prompt_tokens(render.all_pieces(df, template, no_codeblock=True), tok, size).first().tokens
        for size in (1, 300, 10**9)
    }
    assert len(set(counts.values())) == 1, counts


def one_file(spark, body, lines=50):
    """A repository whose files are slices of one text, so that parts may be cut anywhere."""
    rows = [("r", f"f{i:06d}", None, body[i : i + lines], 1) for i in range(0, len(body), lines)]
    df = spark.createDataFrame(rows, "repo string, rel_path string, ext string, content string, tokens bigint")
    return df.withColumn("path", F.col("rel_path")).withColumn("mtime_us", F.lit(0))


@pytest.mark.parametrize(
    "kind, name",
    [("json", "cl100k"), ("digits", "o200k_base"), ("letters", "r50k_base"), ("spaces", "r50k_base"), ("specials", "o200k_base")],
)
def test_counts_carry_over(spark, kind, name):
    """No place in these texts is safe to cut without what came before."""
    body = {
        "json": '{"a": [1, 2], "b": "x\'ll y"}\n\n' * 300,
        "digits": "x" + "0123456789" * 900 + " " + "7" * 3001,
        "letters": "ab" * 5000 + "." + "c" * 7000,
        "spaces": ("    \n\t  " * 200 + "ab  ab\n") * 6 + "end",
        "specials": "<<|endoftext|><|fim_prefix|>ab <|endofprompt|>!!" * 200,
    }[kind]
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"  ": 257, b"\n\n": 258, b"77": 259, b"01": 260, b"}\n": 261, b"012": 262}
    tok = register_tokenizer(name, ranks=ranks)
    # Pieces have no text of their own around the files, so the prompt is the body.
    pieces = render.prompt_pieces(
        render.template_files(one_file(spark, body, 97), no_codeblock=True),
        "{{#each files}}{{code}}{{/each}}",
    )
    whole = "".join(r.text for r in sorted(pieces.collect(), key=lambda r: (r.seg, r.key)))
    plain = spark.createDataFrame([(whole.strip(),)], "t string").select(bpe_tokens(spark, F.col("t"), tok).alias("n")).first().n
    counts = {size: prompt_tokens(pieces, tok, size).first().tokens for size in (900, 1 << 30)}
    assert set(counts.values()) == {plain}, (plain, counts)


def test_no_group_above_a_part(spark):
    """JSON lines of half a megabyte are counted in parts of 4 KiB; none is joined with another."""
    body = '{"k": "v, w", "n": [1, 22, 333]}\n' * 16000
    tok = register_tokenizer("cl100k", ranks={bytes([b]): b for b in range(256)})
    pieces = render.prompt_pieces(render.template_files(one_file(spark, body, 330), no_codeblock=True), "{{#each files}}{{code}}{{/each}}")
    texts = assemble(pieces, ["repo"], render.ORDER, 1 << 12, trim=True).cache()
    steps = counting._steps(texts, tok).cache()
    assert texts.count() > 100 and steps.where("_out is null and not _end").isEmpty()
    assert steps.groupBy("_ways").count().collect() == [(1, texts.count())]


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    return re.findall(r"Exchange (?:hash|range)partitioning\([^\n]*", plan)


def test_texts_move_once(spark, files):
    """Behind the written pieces one exchange, by repository and slice, and no join that moves texts."""
    found = exchanges(render.render_prompts(files))
    assert len(found) == 1 and "(repo#" in found[0]
    found = exchanges(render.render_prompts(files, part_bytes=50))
    assert len(found) == 1 and "_slice" in found[0]


def test_git_streams(spark):
    snap = lambda text: spark.createDataFrame([("r", "menu/day.md", text)], "repo string, rel_path string, content string")
    sections = vcs.git_sections(snap("rice\n"), snap("rice\npeas\n"), snap("corn\npeas\n"))
    lines = sorted(vcs.sections_stream(sections).collect(), key=lambda r: r.key)
    text = "".join(r.text for r in lines)
    file = "diff --git a/menu/day.md b/menu/day.md\n--- a/menu/day.md\n+++ b/menu/day.md\n"
    assert text == (
        f"--- Staged Changes ---\n{file}@@ -1 +1,2 @@\n rice\n+peas\n"
        f"\n--- Unstaged Changes ---\n{file}@@ -1,2 +1,2 @@\n-rice\n+corn\n peas\n"
    )


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """A source of over 70 MiB, also without the files that have no extension, and one of a line."""
    folder = str(tmp_path_factory.mktemp("large"))
    doc = F.col("doc_id")
    spark.range(81, numPartitions=4).withColumnRenamed("id", "doc_id").select(
        "doc_id",
        F.when(doc < 80, F.repeat(F.concat(F.lit("line "), doc.cast("string"), F.lit(" of text\n")), 70_000)).otherwise("x").alias("text"),
        F.when(doc < 80, "src1").otherwise("src2").alias("source"),
        F.lit("en").alias("lang"),
    ).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize(
    "name", ["prompt_json", "render_library", "render_prompt", "render_variant", "render_xml", "write_prompts"]
)
def test_queries_have_whole_prompts(spark, large, name):
    texts = QUERIES[name](spark, large).withColumnRenamed("json", "prompt")
    got = texts.select("repo", "part", F.length("prompt").alias("size")).collect()
    times = 7 if name == "render_library" else 1
    assert sorted((r.repo, r.part) for r in got) == [("src1", 0)] * times + [("src2", 0)] * times
    assert all(r.size > 70 << 20 for r in got if r.repo == "src1")


def test_small_parts_share_slices(spark):
    """What every Python worker holds of a large text is its slices, not its parts; the parts are what they were."""
    rows = [("r", i, f"piece {i:05d} of a text that is cut into small parts") for i in range(3000)]
    pieces = spark.createDataFrame(rows, "repo string, at int, text string").repartition(5)
    placed = assembling.placed_pieces(pieces, ["repo"], ["at"], 20)
    assert placed.select("_slice").distinct().count() <= 2 * assembling.FEW_SLICES
    got = assemble(pieces, ["repo"], ["at"], 20).orderBy("part").collect()
    assert len(got) == 3000 and "".join(r.text for r in got) == "".join(t for _, _, t in rows)
    ends = [sum(len(t) for _, _, t in rows[:i]) // 20 for i in range(3000)]
    assert [r.part for r in got] == ends
