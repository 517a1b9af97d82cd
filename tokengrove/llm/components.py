"""Distributed connected components by contraction.

Each round every vertex hooks to its smallest neighbour if that is smaller; chains of hooks are
followed to their roots by pointer doubling; edges are renamed to roots, loops and repeats
dropped. Only vertices without a smaller neighbour are left, so chains and stars of any size take one
or two rounds and other shapes a few. Each round writes its state to the shared folder. A hub is
one key of joins that Spark splits, and of minima that are taken before the shuffle; no
neighbourhood is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tokengrove.plans.lineage import cut


def _roots(hooks: DataFrame) -> DataFrame:
    """``v, root`` from ``v, p`` with p < v: doubling until nothing moves."""
    state = cut(hooks.select("v", F.col("p").alias("root")))
    while True:
        up = state.select(F.col("v").alias("_v"), F.col("root").alias("_up"))
        state = cut(
            state.join(up, F.col("root") == F.col("_v"), "left").select(
                "v",
                F.coalesce("_up", "root").alias("root"),
                (F.col("_up").isNotNull()).alias("_moved"),
            )
        )
        if not state.where("_moved").limit(1).count():
            return state.select("v", "root")


def connected_components(edges: DataFrame) -> DataFrame:
    """``v, component`` of every vertex of ``edges(a, b)`` but the smallest of each component, whose id is ``component``."""
    pairs = cut(
        edges.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    named = None  # v, component so far
    while True:
        # a < b, so a smallest neighbour below v exists for every b.
        hooks = pairs.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))
        if not pairs.limit(1).count():
            return named if named is not None else pairs.select(F.col("a").alias("v"), F.col("b").alias("component"))
        roots = _roots(hooks)
        if named is None:
            named = roots.select("v", F.col("root").alias("component"))
        else:
            step = roots.select(F.col("v").alias("_v"), F.col("root").alias("_root"))
            named = cut(
                named.join(step, F.col("component") == F.col("_v"), "left")
                .select("v", F.coalesce("_root", "component").alias("component"))
                # Vertices that were roots themselves until now.
                .unionByName(
                    roots.join(named.select(F.col("v").alias("_n")), F.col("v") == F.col("_n"), "left_anti").select(
                        "v", F.col("root").alias("component")
                    )
                )
            )
        ra = roots.select(F.col("v").alias("a"), F.col("root").alias("_ra"))
        rb = roots.select(F.col("v").alias("b"), F.col("root").alias("_rb"))
        pairs = cut(
            pairs.join(ra, "a", "left")
            .join(rb, "b", "left")
            .select(F.coalesce("_ra", "a").alias("x"), F.coalesce("_rb", "b").alias("y"))
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
