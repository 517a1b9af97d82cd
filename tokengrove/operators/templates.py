"""Templates: a few block and variable tags, compiled once on the driver into expressions.

Supported is what prompts need: ``{{name}}``, ``{{{name}}}``, ``{{#if name}}`` and
``{{#each files}}``. Nothing is escaped. A block tag alone on its line takes the line
with it.
"""

from __future__ import annotations

from dataclasses import dataclass
import re

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: the built-in prompt.
DEFAULT_TEMPLATE = """\
Project Path: {{ absolute_code_path }}

Source Tree:

```
{{ source_tree }}
```

{{#each files}}
{{#if code}}
`{{path}}`:

{{code}}

{{/if}}
{{/each}}"""

_FILES = """\
{{#each files}}
{{#if code}}
File `{{path}}`:

{{code}}

{{/if}}
{{/each}}"""
_HEAD = "Project: {{ absolute_code_path }}\n\n```\n{{ source_tree }}\n```\n\n"


def _task(text: str) -> str:
    return f"{_HEAD}{_FILES}\n{text}\n"


_CHALLENGE = "Challenge: {{challenge_name}}\n\n{{challenge_description}}\n\n"

LIBRARY: dict[str, str] = {
    "default": DEFAULT_TEMPLATE,
    "xml": (
        '<corpus root="{{ absolute_code_path }}">\n'
        "{{#if instructions}}\n<task>{{{instructions}}}</task>\n{{/if}}\n"
        "{{#each files}}\n{{#if code}}\n"
        '<document name="{{path}}">\n{{{code}}}\n</document>\n{{/if}}\n{{/each}}\n'
        "<layout>\n{{{source_tree}}}\n</layout>\n</corpus>\n"
    ),
    "clean-up": _task("Tidy this code: simpler names, less repetition, same behaviour."),
    "document": _task("Write documentation comments for everything public here."),
    "refactor": _task("Propose a better structure for this code and show the changed files."),
    "fix-bugs": _task("Find mistakes in this code. Give path, line, cause and a fix for each."),
    "security": _task("Look for vulnerabilities. Rate each and say how to close it."),
    "performance": _task("Find what is slow or wasteful and rewrite it."),
    "readme": _task("Write a README: purpose, installation, use, layout."),
    "commit": (
        "Write a commit message: a short imperative subject, then why.\n\n"
        "{{#if git_diff}}\n# What changed\n\n~~~diff\n{{git_diff}}\n~~~\n\n{{/if}}\n"
        "# Files of {{ absolute_code_path }}\n\n{{ source_tree }}\n"
    ),
    "pull-request": (
        "Describe a pull request: motivation, changes, how to try it.\n\n"
        "{{#if git_log_branch}}\n# Commits, oldest first\n\n{{git_log_branch}}\n{{/if}}\n"
        "# Files of {{ absolute_code_path }}\n\n{{ source_tree }}\n"
        "{{#if git_diff_branch}}\n# Changes of the branch\n\n~~~diff\n{{git_diff_branch}}\n~~~\n{{/if}}\n"
    ),
    "web-challenge": _CHALLENGE + "Target: {{target_url}}\n\n" + _task("Explain how this training exercise is solved."),
    "crypto-challenge": _CHALLENGE + _task("Explain which weakness of the cipher this exercise teaches."),
    "reversing-challenge": _CHALLENGE + _task("Explain what this program checks, step by step."),
    "binary-challenge": _CHALLENGE + _task("Explain which memory mistake this exercise teaches."),
}

SCOPES = ("explicit", "project", "user", "builtin")  # first present wins


def choose_template(templates: DataFrame) -> DataFrame:
    """One template per repository of ``templates(repo, scope, body)``, with its identity.

    The identity is the sha256 of the body, or ``builtin``.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in SCOPES]), F.col("scope"))
    best = (
        templates.where(rank > 0)
        .groupBy("repo")
        .agg(F.min(F.struct(rank.alias("rank"), F.col("body"), F.col("scope"))).alias("_best"))
        .select("repo", "_best.scope", "_best.body")
    )
    identity = F.when(F.col("scope") == "builtin", F.lit("builtin")).otherwise(F.sha2("body", 256))
    return best.withColumn("identity", identity)


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class If:
    name: str
    body: tuple


@dataclass(frozen=True)
class Each:
    body: tuple


_ALONE = re.compile(r"^[ \t]*(\{\{[#/][^{}]*\}\})[ \t]*(?:\r?\n|\Z)", re.MULTILINE)
_TAG = re.compile(r"\{\{\{\s*([^{}]+?)\s*\}\}\}|\{\{\s*([^{}]+?)\s*\}\}")


def parse_template(template: str) -> tuple:
    """The nodes of a template; raises ``ValueError`` on tags that are not supported."""
    source = _ALONE.sub(r"\1", template)
    stack: list[tuple[str, str, list]] = [("", "", [])]
    at = 0
    for tag in _TAG.finditer(source):
        if tag.start() > at:
            stack[-1][2].append(Text(source[at : tag.start()]))
        at = tag.end()
        words = (tag[1] or tag[2]).split()
        if words[0] in ("#if", "#each") and len(words) == 2:
            if words[0] == "#each" and words[1] != "files":
                raise ValueError(f"can only loop over files, not {words[1]}")
            stack.append((words[0][1:], words[1], []))
        elif words[0] in ("/if", "/each") and len(words) == 1:
            kind, name, body = stack.pop()
            if kind != words[0][1:]:
                raise ValueError(f"unexpected {{{{{words[0]}}}}}")
            stack[-1][2].append(If(name, tuple(body)) if kind == "if" else Each(tuple(body)))
        elif len(words) == 1 and re.fullmatch(r"[A-Za-z_][\w.-]*", words[0]) and words[0] != "else":
            stack[-1][2].append(Var(words[0]))
        else:
            raise ValueError(f"unsupported tag {tag[0]!r}")
    if at < len(source):
        stack[-1][2].append(Text(source[at:]))
    if len(stack) != 1:
        raise ValueError(f"unclosed {{{{#{stack[-1][0]}}}}}")
    return tuple(stack[0][2])


NUMERIC = ("token_count", "this.token_count")


def holds(name: str, text: Column) -> Column:
    """Does an ``if`` on the field hold? Empty text does not, and neither does the number 0."""
    return (text != "") & (text != "0") if name in NUMERIC else text != ""


def render_nodes(nodes: tuple, value) -> Column:
    """Nodes as one string expression; ``value(name)`` gives a string column, '' if unknown."""
    pieces = []
    for node in nodes:
        if isinstance(node, Text):
            pieces.append(F.lit(node.text))
        elif isinstance(node, Var):
            pieces.append(value(node.name))
        elif isinstance(node, If):
            inner = render_nodes(node.body, value)
            pieces.append(F.when(holds(node.name, value(node.name)), inner).otherwise(F.lit("")))
        else:
            raise ValueError("a loop inside a loop")
    return F.concat(*pieces) if pieces else F.lit("")
