"""Embedding near-duplicates: sign hashing in several tables, exact cosines, components.

A table hashes a vector to the signs of its products with random hyperplanes; vectors at cosine
``c`` agree in one sign with probability ``1 - acos(c) / pi``. The number of signs follows the number
of vectors, so that a bucket of unrelated vectors stays about ``BUCKET`` rows at any size, and
the number of tables follows from the signs, so that a pair at the threshold meets in one with
probability ``RECALL`` (closer ones meet almost surely). Vectors that meet are compared exactly, in
double precision, by blocks: a bucket above ``BLOCK`` rows is cut by a hash of the id, and every two
cuts are one block, so no task holds a bucket and no pair leaves a block. A pair is counted in
the first table in which it meets. A block returns a row per linked vector: its new links and the
smallest id of its links within the block, which keeps connectivity with linear output.

Cost: each vector is shuffled once per table, and a bucket of ``m`` near copies costs ``m^2`` products
because ``n_links`` counts them all.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; so do vectors of different lengths, and rows with a null id (component null, not kept).
Rows that repeat an id are one vector for links; each returns its row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tokengrove.llm.components import connected_components
from tokengrove.plans.lineage import cut
from tokengrove.plans.skew import salted_join

THRESHOLD, RECALL = 0.9, 0.98
BUCKET, BLOCK = 16, 512
MOST_SIGNS = 30
SEED = 20


def table_plan(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Signs per table and tables for so many vectors."""
    signs = max(4, min(MOST_SIGNS, math.ceil(math.log2(max(2, vectors / BUCKET)))))
    meet = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def unit(vectors: np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linked_within(x: np.ndarray, codes: np.ndarray, table: int, cut_of: np.ndarray, threshold: float):
    """Pairs of one block at or above the threshold that meet in no earlier table."""
    cuts = np.unique(cut_of)
    first, second = (cut_of == cuts[0]), (cut_of == cuts[-1])
    i, j = np.flatnonzero(first), np.flatnonzero(second)
    near = x[i] @ x[j].T >= threshold
    a, b = np.nonzero(near)
    a, b = i[a], j[b]
    if len(cuts) == 1:
        a, b = a[a < b], b[a < b]
    new = np.ones(len(a), bool)
    for start in range(0, len(a), 100_000):
        at = slice(start, start + 100_000)
        new[at] = ~(codes[a[at], :table] == codes[b[at], :table]).any(axis=1)
    return a[new], b[new]


def smallest_linked(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row the smallest id it reaches by the pairs."""
    best = ids.copy()
    while True:
        low = np.minimum(best[a], best[b])
        after = best.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        if (after == best).all():
            return best
        best = after


def link_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    spark = vectors.sparkSession
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("_v"))
    big = F.lit(float("inf"))
    good = (
        F.col("vec_id").isNotNull()
        & F.col("_v").isNotNull()
        & F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < big))
        & F.exists("_v", lambda c: c != 0)
    )
    usable = rows.where(F.coalesce(good, F.lit(False))).dropDuplicates(["vec_id"])
    signs, tables = table_plan(usable.count(), threshold)

    def hash_signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(signs, dtype=np.int64)
        for batch in batches:
            width = batch["_v"].map(len).to_numpy()
            for dim in np.unique(width):
                part = batch[width == dim]
                x = unit(np.stack(part["_v"].to_list()))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, int(dim)]).standard_normal((dim, tables * signs))
                bits = (x @ planes[dim] > 0).reshape(len(part), tables, signs)
                codes = (bits * weights).sum(axis=2).astype(np.int32)
                yield pd.DataFrame(
                    {"vec_id": part["vec_id"].to_numpy(), "_v": part["_v"].to_numpy(), "_dim": dim, "_codes": list(codes)}
                )

    kind = dict(rows.dtypes)["_v"]
    coded = cut(usable.mapInPandas(hash_signs, f"vec_id long, _v {kind}, _dim int, _codes array<int>"))
    key = ["_table", "_code", "_dim"]
    spread = coded.select("*", F.posexplode("_codes").alias("_table", "_code"))
    sizes = spread.groupBy(*key).agg(F.count("*").alias("_m")).where(F.col("_m") > 1)
    hot = cut(sizes.where(F.col("_m") > BLOCK).select(*key, F.ceil(F.col("_m") / F.lit(BLOCK)).cast("int").alias("_cuts")))
    sized = salted_join(spread, hot, key, "left", ["vec_id"])
    own = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.col("_cuts")).cast("int")
    blocks = (
        sized.withColumn("_cut", F.when(F.col("_cuts").isNull(), 0).otherwise(own))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_cuts"), F.lit(1)) - 1)))
        .select(
            "vec_id", "_v", "_codes", *key, "_cut",
            F.least("_cut", "_other").alias("_lo"), F.greatest("_cut", "_other").alias("_hi"),
        )
    )
    block = [*key, "_lo", "_hi"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(part: pd.DataFrame) -> pd.DataFrame | None:
            if len(part) < 2:
                return None
            ids = part["vec_id"].to_numpy()
            lo, hi = part["_lo"].iat[0], part["_hi"].iat[0]
            cut_of = part["_cut"].to_numpy()
            if lo != hi and (cut_of == cut_of[0]).all():
                return None
            a, b = linked_within(
                unit(np.stack(part["_v"].to_list())), np.stack(part["_codes"].to_list()),
                int(part["_table"].iat[0]), cut_of, threshold,
            )
            if not len(a):
                return None
            links = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
            best = smallest_linked(ids, a, b)
            at = np.flatnonzero(links)
            return pd.DataFrame({"vec_id": ids[at], "links": links[at], "rep": best[at]})

        open_part: pd.DataFrame | None = None
        for batch in batches:
            if open_part is not None:
                batch = pd.concat([open_part, batch], ignore_index=True)
            keys = batch[block].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
            for start, stop in zip(starts, starts[1:]):
                found = one(batch.iloc[start:stop])
                if found is not None:
                    yield found
            open_part = batch.iloc[starts[-1] :]
        if open_part is not None:
            found = one(open_part)
            if found is not None:
                yield found

    linked = cut(
        blocks.repartition(*block)
        .sortWithinPartitions(*block)
        .mapInPandas(compare, "vec_id long, links long, rep long")
    )
    counts = linked.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    named = connected_components(linked.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    return (
        rows.select("vec_id")
        .join(counts, "vec_id", "left")
        .join(named.select(F.col("v").alias("vec_id"), "component"), "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
