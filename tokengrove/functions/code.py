"""Code blocks and line numbers, one row at a time."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def lines_of(content: Column) -> Column:
    """Lines split at ``\\n`` or ``\\r\\n``; a newline at the end starts no further line."""
    lines = F.split(content, "\r?\n", -1)
    ends_open = (content == "") | F.endswith(content, F.lit("\n"))
    return F.when(ends_open, F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def numbered(content: Column) -> Column:
    """Every line as its number, right-aligned to four places, a bar and the line."""

    def one(line: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        return F.concat(
            F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit(" ")),
            F.lit(" | "),
            line,
            F.lit("\n"),
        )

    return F.array_join(F.transform(lines_of(content), one), "")


def wrap_code(
    content: Column, ext: Column, line_numbers: bool = False, no_codeblock: bool = False
) -> Column:
    """A fenced block. ``no_codeblock`` leaves the text as it is, line numbers included."""
    if no_codeblock:
        return content
    body = numbered(content) if line_numbers else content
    return F.concat(
        F.lit("```"), F.coalesce(ext, F.lit("")), F.lit("\n"), body, F.lit("```")
    )
