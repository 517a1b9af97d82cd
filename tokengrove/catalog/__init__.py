"""Registered queries over the test tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from importlib import import_module

TOPICS = ("rollups", "filters", "caching", "prompts", "history", "counting", "scanning")


def load():
    """``(queries, oracles)`` by name."""
    for topic in TOPICS:
        import_module(f"tokengrove.catalog.{topic}")
    from tokengrove.catalog.base import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
