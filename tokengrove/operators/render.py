"""From files to prompts.

A prompt is treated as ordered pieces: the text between variables, the lines of trees
and diffs, one section per file. Pieces are rows until the very end, so a repository
of any size renders; see :mod:`tokengrove.plans.assemble`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tokengrove.functions.code import wrap_code
from tokengrove.functions.paths import parts_of
from tokengrove.functions.text import json_text
from tokengrove.functions.tokens import ENCODINGS, tokens_bytes4
from tokengrove.operators.order import rank_files
from tokengrove.operators.templates import (
    DEFAULT_TEMPLATE,
    Each,
    If,
    Text,
    Var,
    parse_template,
    render_nodes,
)
from tokengrove.operators.tree import source_tree
from tokengrove.plans.assemble import PART_BYTES, assemble, assemble_versions, join_parts, placed_pieces, write_pieces
from tokengrove.plans.lineage import cut
from tokengrove.plans.skew import salted_join

ORDER = ["seg", "key"]
_NO_KEY = "array<string>"


def path_value(absolute: bool = False) -> Column:
    """The path a prompt shows."""
    return F.col("path") if absolute else F.col("rel_path")


def model_info(tokenizer: Column) -> Column:
    """The models an encoding belongs to."""
    pairs = [F.lit(x) for name, (_, _, text) in ENCODINGS.items() for x in (name, text)]
    return F.create_map(*pairs)[tokenizer]


def template_files(
    files: DataFrame,
    absolute: bool = False,
    line_numbers: bool = False,
    no_codeblock: bool = False,
    sort: str = "name-asc",
) -> DataFrame:
    """What a template's loop sees, ``(repo, key, path, extension, code, token_count)``.

    Files without content are left out; ``key`` orders the files of a repository.
    """
    if sort == "name-asc":
        keyed = files.withColumn("key", parts_of(F.col("rel_path")))
    else:
        ranks = cut(
            rank_files(files.select("repo", "rel_path", "mtime_us"), sort, "_rank").select(
                "repo",
                "rel_path",
                F.array(F.lpad(F.col("_rank").cast("string"), 20, "0")).alias("key"),
            )
        )
        keyed = files.join(ranks, ["repo", "rel_path"])
    ext = F.coalesce("ext", F.lit(""))
    return keyed.where(F.col("content").isNotNull()).select(
        "repo",
        "key",
        path_value(absolute).alias("path"),
        ext.alias("extension"),
        wrap_code(F.col("content"), ext, line_numbers, no_codeblock).alias("code"),
        F.col("tokens").alias("token_count"),
    )


def _file_field(name: str) -> Column:
    field = name.removeprefix("this.")
    if field in ("path", "extension", "code", "token_count"):
        return F.coalesce(F.col(field).cast("string"), F.lit(""))
    return F.lit("")


def file_sections(entries: DataFrame, body: tuple | None = None) -> DataFrame:
    """One rendered section ``(repo, key, text)`` per file; by default that of the built-in prompt."""
    if body is None:
        body = next(n for n in parse_template(DEFAULT_TEMPLATE) if isinstance(n, Each)).body
    return entries.select("repo", "key", render_nodes(body, _file_field).alias("text"))


def _flatten(nodes: tuple, conds: tuple[str, ...] = ()):
    """Top-level nodes with the names their enclosing ``if`` blocks test."""
    for node in nodes:
        if isinstance(node, If):
            yield from _flatten(node.body, (*conds, node.name))
        else:
            yield node, conds


def _names(nodes: tuple) -> set[str]:
    """Every name a template mentions."""
    found: set[str] = set()
    for node in nodes:
        if isinstance(node, (Var, If)):
            found.add(node.name)
        if isinstance(node, (If, Each)):
            found |= _names(node.body)
    return found


def _segments(template: str, streams: Mapping[str, DataFrame] | None, variables: DataFrame | None) -> list[tuple]:
    """A template's segments in order: ``(None, nodes, conds)`` of fixed text, ``(name, node, conds)`` of long rows."""
    found: list[tuple] = []
    run: list[Text | Var] = []
    run_conds: tuple[str, ...] = ()

    def flush() -> None:
        if run:
            found.append((None, tuple(run), run_conds))
            run.clear()

    for node, conds in _flatten(parse_template(template)):
        if conds != run_conds:
            flush()
            run_conds = conds
        if isinstance(node, Text) or isinstance(node, Var) and node.name not in (streams or {}):
            run.append(node)
        else:
            if isinstance(node, Var) and variables is not None:
                run.append(node)
            flush()
            found.append(("files" if isinstance(node, Each) else node.name, node, conds))
    flush()
    if all(name is not None for name, _, _ in found):  # so that a prompt without any section is an empty one, not a missing row
        found.append((None, (), ()))
    return found


def _layout(segments: list[tuple]) -> tuple:
    """What templates have in common whose prompts differ in fixed text only."""
    return tuple(None if name is None else (name, node, conds) for name, node, conds in segments)


def prompt_pieces(
    entries: DataFrame,
    template: str | Sequence[str] = DEFAULT_TEMPLATE,
    streams: Mapping[str, DataFrame] | None = None,
    variables: DataFrame | None = None,
    label: Column | None = None,
    repos: DataFrame | None = None,
) -> DataFrame:
    """The prompt of every repository as ``(repo, seg, key, text)``.

    ``entries`` comes from :func:`template_files`. ``streams`` gives long built-in
    values as lines ``(repo, key, text)``: ``source_tree``, ``git_diff``,
    ``git_diff_branch``, ``git_log_branch``. ``variables(repo, key, value)`` override
    built-ins. ``repos`` lists who gets a prompt, by default whoever has entries.
    Of several templates of one layout the rows are those of all; ``texts`` has the fixed text of each.
    """
    streams = dict(streams or {})
    bodies = [template] if isinstance(template, str) else list(template)
    versions = [_segments(body, streams, variables) for body in bodies]
    if len({*map(_layout, versions)}) > 1:
        raise ValueError("templates of several layouts")
    repo_row = (entries if repos is None else repos).select("repo").distinct().withColumn(
        "_label", F.col("repo") if label is None else label
    )
    if variables is None:
        repo_row = repo_row.withColumn("_vars", F.lit(None).cast("map<string,string>"))
    else:
        names = sorted(set().union(*(_names(parse_template(body)) for body in bodies)))
        variables = variables.where(F.col("key").isin(names))
        maps = variables.groupBy("repo").agg(
            F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_vars")
        )
        repo_row = repo_row.join(maps, "repo", "left")
    tested = {c for body in bodies for _, conds in _flatten(parse_template(body)) for c in conds}
    for name in sorted(tested & set(streams)):
        full = (
            streams[name].where(F.col("text") != "").select("repo").distinct()
            .withColumn(f"_has_{name}", F.lit("1"))
        )
        repo_row = repo_row.join(full, "repo", "left")
    if "files" in tested:
        full = entries.select("repo").distinct().withColumn("_has_files", F.lit("1"))
        repo_row = repo_row.join(full, "repo", "left")

    def scalar(name: str) -> Column:
        choices = [F.col("_vars")[name]]
        if name == "absolute_code_path":
            choices.append(F.col("_label"))
        return F.coalesce(*choices, F.lit(""))

    def truth(name: str) -> Column:
        if name in streams or name == "files":
            return F.coalesce(F.col("_vars")[name], F.col(f"_has_{name}"), F.lit("")) != ""
        return scalar(name) != ""

    def passing(conds: tuple[str, ...]) -> Column | None:
        return reduce(lambda a, b: a & b, map(truth, conds)) if conds else None

    def only_passing(rows: DataFrame, name: str, conds: tuple[str, ...]) -> DataFrame:
        others = tuple(c for c in conds if c != name)
        if others:
            ok = repo_row.where(passing(others)).select("repo")
            rows = salted_join(rows, ok, ["repo"], "left_semi", ["key"])
        if variables is not None:
            own = repo_row.where(F.col("_vars")[name].isNotNull()).select("repo")
            rows = salted_join(rows, own, ["repo"], "left_anti", ["key"])
        return rows

    def fixed_text(run: tuple, conds: tuple[str, ...]) -> Column:
        text = F.concat(*[F.lit(n.text) if isinstance(n, Text) else scalar(n.name) for n in run]) if run else F.lit("")
        cond = passing(conds)
        return text if cond is None else F.when(cond, text).otherwise(F.lit(""))

    scalars: list[Column] = []
    long_rows: list[DataFrame] = []
    several = not isinstance(template, str)
    none = F.lit(None).cast("array<string>")
    for seg, (name, node, conds) in enumerate(versions[0]):
        if name is None:
            texts = [fixed_text(*version[seg][1:]) for version in versions]
            held = [F.lit("").alias("text"), F.array(*texts).alias("texts")] if several else [texts[0].alias("text")]
            scalars.append(F.struct(F.lit(seg).alias("seg"), *held))
        else:
            rows = file_sections(entries, node.body) if isinstance(node, Each) else streams[name]
            rows = only_passing(rows, name, conds).select("repo", F.lit(seg).alias("seg"), "key", "text")
            long_rows.append(rows.withColumn("texts", none) if several else rows)
    fixed = repo_row.select("repo", F.explode(F.array(*scalars)).alias("_p")).select(
        "repo", "_p.seg", F.array().cast(_NO_KEY).alias("key"), "_p.text", *["_p.texts"] * several
    )
    return reduce(DataFrame.unionByName, long_rows, fixed)


def all_pieces(
    files: DataFrame,
    template: str | Sequence[str] = DEFAULT_TEMPLATE,
    *,
    full_directory_tree: bool = False,
    absolute: bool = False,
    line_numbers: bool = False,
    no_codeblock: bool = False,
    sort: str = "name-asc",
    streams: Mapping[str, DataFrame] | None = None,
    variables: DataFrame | None = None,
) -> DataFrame:
    """The prompt pieces of a corpus, source tree included."""
    lines = dict(streams or {})
    if "source_tree" not in lines:
        tree = source_tree(files, full_directory_tree)
        # Lines are read more than once; a nested tree takes several joins to draw.
        lines["source_tree"] = cut(tree) if full_directory_tree else tree
    entries = template_files(files, absolute, line_numbers, no_codeblock, sort)
    return prompt_pieces(entries, template, lines, variables, repos=files)


def placed_prompts(
    files: DataFrame, template: str = DEFAULT_TEMPLATE, part_bytes: int = PART_BYTES, **options
) -> DataFrame:
    """The pieces of :func:`render_prompts`, trimmed and assigned to parts, not yet joined."""
    pieces = all_pieces(files, template, **options)
    return placed_pieces(pieces, ["repo"], ORDER, part_bytes, trim=True)


def render_prompts(
    files: DataFrame, template: str | Mapping[str, str] = DEFAULT_TEMPLATE, part_bytes: int = PART_BYTES, **options
) -> DataFrame:
    """The trimmed prompt of every repository, ``(repo, part, prompt)``.

    ``options`` are those of :func:`all_pieces`. Most prompts are part 0 alone. One
    larger than ``part_bytes`` continues in further parts, which concatenated give the
    prompt unchanged. Named templates give ``(repo, part, prompt, template)``; those that differ in
    fixed text only share their pieces, which are written and shuffled once.
    """
    if isinstance(template, str):
        placed = placed_prompts(files, template, part_bytes, **options)
        return join_parts(placed, ["repo"], ORDER).withColumnRenamed("text", "prompt")
    alike: dict[tuple, dict[str, str]] = {}
    streams = {"source_tree": None} | dict(options.get("streams") or {})
    for name, body in template.items():
        alike.setdefault(_layout(_segments(body, streams, options.get("variables"))), {})[name] = body
    rendered = []
    for named in alike.values():
        pieces = all_pieces(files, [*named.values()], **options)
        rendered.append(assemble_versions(pieces, ["repo"], ORDER, [*named], part_bytes, trim=True))
    found = reduce(DataFrame.unionByName, rendered)
    return found.select("repo", "part", F.col("text").alias("prompt"), F.col("version").alias("template"))


def prompt_tokens_bytes4(placed: DataFrame) -> DataFrame:
    """Byte-based tokens of each whole prompt, from its pieces."""
    return placed.groupBy("repo").agg(
        tokens_bytes4(F.sum(F.octet_length("text"))).alias("tokens")
    )


def prompt_json(
    placed: DataFrame,
    files: DataFrame,
    tokenizer: str,
    tokens: DataFrame | None = None,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """One JSON record per repository, ``(repo, part, parts, json)``, keys in alphabetical order.

    ``placed`` comes from :func:`placed_prompts`. ``files`` lists absolute paths whatever the prompt shows.
    ``tokens`` is ``(repo, tokens)`` of the prompts, the byte-based count by default. Escaping works
    character by character, so escaped pieces concatenate to the escaped prompt. They are written
    once and placed by their escaped sizes; ``parts`` is how many parts the record has.
    """
    order = ["seg", "sub", "key"]
    prompt = write_pieces(
        placed.select(
            "repo",
            F.lit(3).alias("seg"),
            F.col("seg").alias("sub"),
            "key",
            json_text(F.col("text")).alias("text"),
            F.octet_length("text").alias("_raw"),
        ),
        ["repo"],
        order,
        _raw=F.col("_raw"),
    )
    if tokens is None:
        tokens = prompt.groupBy("repo").agg(tokens_bytes4(F.sum("_raw")).alias("tokens"))
    first = files.groupBy("repo").agg(F.min(parts_of(F.col("rel_path"))).alias("_first"))
    head = F.concat(
        F.lit('{"directory_name":"'), json_text(F.col("repo")), F.lit('","files":[')
    )
    between = F.concat(
        F.lit('],"model_info":"'),
        json_text(model_info(F.lit(tokenizer))),
        F.lit('","prompt":"'),
    )
    tail = F.concat(F.lit('","token_count":'), F.col("tokens").cast("string"), F.lit("}"))
    frame = tokens.select(
        "repo",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(seg).alias("seg"), text.alias("text"))
                    for seg, text in ((0, head), (2, between), (4, tail))
                ]
            )
        ).alias("_p"),
    ).select(
        "repo",
        "_p.seg",
        F.lit(0).alias("sub"),
        F.array().cast(_NO_KEY).alias("key"),
        "_p.text",
    )
    key = parts_of(F.col("rel_path"))
    firsts = first.select("repo", F.array_join("_first", "/").alias("rel_path"), F.lit("").alias("_comma"))
    paths = (
        files.select("repo", "rel_path", "path")
        .join(firsts, ["repo", "rel_path"], "left")
        .select(
            "repo",
            F.lit(1).alias("seg"),
            F.lit(0).alias("sub"),
            key.alias("key"),
            F.concat(
                F.coalesce("_comma", F.lit(",")), F.lit('"'), json_text(F.col("path")), F.lit('"')
            ).alias("text"),
        )
    )
    sized = frame.unionByName(paths).withColumns(
        {"_bytes": F.octet_length("text").cast("bigint"), "_solid": F.lit(1).cast("bigint")}
    )
    pieces = sized.unionByName(prompt.drop("_raw"))
    return assemble(pieces, ["repo"], order, part_bytes, written=True, count=True).withColumnRenamed("text", "json")
