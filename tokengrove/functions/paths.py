"""Path expressions over ``/``-separated relative paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def forward_slashes(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def strip_root(path: Column, root: Column) -> Column:
    """``path`` relative to ``root``; a path outside the root stays whole."""
    p, r = forward_slashes(path), forward_slashes(root)
    prefix = F.concat(r, F.lit("/"))
    return F.when(F.startswith(p, prefix), F.substring(p, F.length(prefix) + 1, F.length(p))).otherwise(p)


def parts_of(c: Column) -> Column:
    return F.split(c, "/", -1)


def name_of(c: Column) -> Column:
    return F.element_at(parts_of(c), -1)


def depth_of(node: Column) -> Column:
    """0 for the root ``''``, 1 for a top-level node."""
    return F.when(node == "", F.lit(0)).otherwise(F.size(parts_of(node)))


def parent_of(c: Column) -> Column:
    """The directory of a path, ``''`` at the top level."""
    parts = parts_of(c)
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")


def extension_of(rel_path: Column) -> Column:
    """What follows the last dot of the name, if something precedes that dot; else null."""
    name = name_of(rel_path)
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.substring_index(name, ".", -1))


def ancestors(node: Column, root: bool = True, itself: bool = True) -> Column:
    """Array of the node's ancestors, top down. ``''`` is the root; its only ancestor is itself."""
    parts = F.filter(parts_of(node), lambda p: p != "") if root else parts_of(node)
    first = 0 if root else 1
    last = F.size(parts) if itself else F.size(parts) - 1
    return F.when(
        last >= first,
        F.transform(
            F.sequence(F.lit(first), F.greatest(last, F.lit(first))),
            lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))


def is_hidden(rel_path: Column) -> Column:
    """Does any component start with a dot?"""
    return rel_path.rlike(r"(^|/)[.]")


def path_label(path: Column, root_label: str = ".") -> Column:
    """The last component of a path, or ``root_label`` if it has none."""
    name = F.regexp_extract(forward_slashes(path), r"([^/]+)/*$", 1)
    return F.when((name == "") | name.isin(".."), F.lit(root_label)).otherwise(name)
