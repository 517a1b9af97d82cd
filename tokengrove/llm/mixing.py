"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Sources weigh 5, 2, 1, 5, 2, 1, ... in order of their names (code points, null last) and share
the corpus's words; no target exceeds ``MOST_EPOCHS`` times its source, what is above goes
to the other sources by weight until none is above. A target of ``k`` full epochs and a rest takes
every document ``k`` times and then, in the order of the keys ``-ln(u) / weight``, the documents
whose running sum of words reaches the rest: a document whose words straddle the rest is
taken if most of them lie before it. ``u`` is a hash of the document, so reruns agree.

Scale: only ids, sizes and keys move. Running sums come from range slices of (source, key), so
no window holds a source; the table of sources is ranked the same way and joins the
documents salted.

Defined cases: a null text has no words, size 0 and is taken 0 words. A null source is one
source. Rows that repeat an id and text are separate documents with equal keys. Without any
words all targets are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tokengrove.llm.base import WORD
from tokengrove.plans.lineage import cut
from tokengrove.plans.skew import salted_join
from tokengrove.plans.slices import running

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def _name(source: Column) -> Column:
    """A name for every source, null too, that can be joined on."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.05 to 1: the share of ASCII letters and non-ASCII characters among all but spaces."""
    solid = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace(text, r"[\x00-@\[-`{-\x7F]+", ""))
    return F.when(solid > 0, F.greatest(F.lit(0.05), letters / solid)).otherwise(0.05)


def sampling_key(weight: Column, *identity: Column | str, seed: int = 0) -> Column:
    """``-ln(u) / weight``: the smallest keys are a weighted sample without replacement.

    ``u`` has 52 bits of the SHA-256 of the identity.
    """
    text = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in identity])
    bits = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")
    return -F.ln((bits.cast("double") + 0.5) / float(1 << 52)) / weight


def source_targets(
    sources: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS
) -> DataFrame:
    """``_source, source_size, target`` from rows of ``_source, source_size``.

    In order of ``cap / weight`` the sources that end at their cap come first. One ends there
    if the level, what is left over the weight that is left, reaches its own ratio; all
    others get weight times the last level.
    """
    named = running(sources, [], [F.col("_source").isNull(), F.col("_source")], {"_rank": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    rated = named.select(
        "_source", "source_size", weight.cast("long").alias("_w"), (F.col("source_size") * most_epochs).alias("_cap"), "_rank"
    ).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    filled = running(
        rated,
        [],
        [F.col("_ratio"), F.col("_rank")],
        {"_cap_before": F.col("_cap"), "_w_before": F.col("_w")},
    )
    whole = sources.agg(F.sum("source_size").alias("b")).first()
    total_weight = rated.agg(F.sum("_w").alias("w")).first()["w"] or 0
    budget = whole["b"] or 0
    left = (F.lit(budget) - F.col("_cap_before")) / (F.lit(total_weight) - F.col("_w_before")).cast("double")
    marked = cut(filled.withColumn("_full", left >= F.col("_ratio")))
    used = marked.where("_full").agg(F.sum("_cap").alias("c"), F.sum("_w").alias("w")).first()
    open_weight = total_weight - (used["w"] or 0)
    level = (budget - (used["c"] or 0)) / open_weight if open_weight else 0.0
    return marked.select(
        "_source",
        F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_w") * F.lit(float(level))).alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
    seed: int = 0,
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, epochs, last_epoch, _key, taken``."""
    text = F.col(text_col)
    sized = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("_source"),
            _name(F.col(source_col)).alias("_name"),
            word_count(text).alias("size"),
            sampling_key(quality_weight(text), F.col(id_col).cast("string"), text, seed=seed).alias("_key"),
        )
    )
    sources = cut(sized.groupBy("_source").agg(F.sum("size").alias("source_size")))
    targets = source_targets(sources, weights, most_epochs)
    placed = running(
        sized, ["_name"], [F.col("_key"), F.col("doc_id")], {"_before": F.col("size")}, {"_all": "_before"}
    )
    joined = salted_join(placed, targets.select(_name(F.col("_source")).alias("_name"), "target"), ["_name"], "inner", ["_key"])
    epochs = F.when(F.col("_all") > 0, F.floor(F.col("target") / F.col("_all"))).otherwise(0).cast("long")
    rest = F.col("target") - epochs * F.col("_all")
    # The middles of documents grow along the keys, so the documents of the last, fractional
    # epoch are a prefix of their source.
    return joined.select(
        "doc_id",
        F.col("_source").alias("source"),
        "size",
        F.col("_all").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        F.when(F.col("size") > 0, epochs).otherwise(0).cast("long").alias("epochs"),
        ((F.col("size") > 0) & (epochs < most_epochs) & (F.col("_before") + F.col("size") / 2 <= rest)).alias("last_epoch"),
        "_key",
    ).withColumn("taken", (F.col("epochs") + F.col("last_epoch").cast("long")) * F.col("size"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    return mix(docs, **options).select("doc_id", "size", "source_size", "target", "taken")


def take_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it does, all columns as they are.

    What a source is taken is told by its epochs and the last key of its last epoch, so texts
    meet one row per source and no document is joined to another. Rows of that same id and
    key are taken alike.
    """
    mixed = mix(docs, id_col, text_col, source_col, **options)
    bounds = cut(
        mixed.where("size > 0")
        .groupBy("source")
        .agg(
            F.max("epochs").alias("_epochs"),
            F.max(F.when(F.col("last_epoch"), F.struct("_key", "doc_id"))).alias("_last"),
        )
        .select(_name(F.col("source")).alias("_name"), "_epochs", "_last")
    )
    text = F.col(text_col)
    key = sampling_key(quality_weight(text), F.col(id_col).cast("string"), text, seed=options.get("seed", 0))
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no clash with what is added
    rows = docs.select(
        *[F.col(f"`{c}`").alias(at[c]) for c in docs.columns],
        _name(F.col(source_col)).alias("_name"),
        key.alias("_key"),
        F.col(id_col).alias("_id"),
        word_count(text).alias("_size"),
    ).where("_size > 0")
    found = salted_join(rows, bounds, ["_name"], "inner", ["_key"])
    more = F.coalesce(F.struct("_key", F.col("_id").alias("doc_id")) <= F.col("_last"), F.lit(False)).cast("int")
    copies = (F.col("_epochs") + more).cast("int")
    return (
        found.withColumn("_copies", copies)
        .where("_copies > 0")
        .select(*at.values(), F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
        .select(*[F.col(at[c]).alias(c) for c in docs.columns])
    )


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    CASE WHEN len(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) > 0
         THEN greatest(0.05::DOUBLE, len(regexp_replace(text, '[\\x00-@\\[-`{{-\\x7F]+', '', 'g'))::DOUBLE
              / len(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::DOUBLE) ELSE 0.05::DOUBLE END AS w
  FROM documents),
keyed AS (
  SELECT *, -ln((('0x' || substr(sha256('0' || chr(31) || COALESCE(CAST(doc_id AS VARCHAR), '') || chr(31) || COALESCE(text, '')), 1, 13))::BIGINT
                 ::DOUBLE + 0.5) / {float(1 << 52)!r}::DOUBLE) / w AS k
  FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source COLLATE C) - 1) % 3 + 1)::INT] AS sw
  FROM keyed GROUP BY source),
ranked AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / sw::DOUBLE AS ratio,
    COALESCE(sum(3 * source_size) OVER o, 0) AS cap_before, COALESCE(sum(sw) OVER o, 0) AS w_before,
    sum(source_size) OVER () AS budget, sum(sw) OVER () AS all_w
  FROM sources
  WINDOW o AS (ORDER BY 3 * source_size / sw::DOUBLE, source IS NULL, source COLLATE C
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, (budget - cap_before) / (all_w - w_before)::DOUBLE >= ratio AS is_full FROM ranked),
level AS (
  SELECT CASE WHEN max(all_w) > COALESCE(sum(sw) FILTER (is_full), 0)
         THEN ((max(budget) - COALESCE(sum(cap) FILTER (is_full), 0))::DOUBLE
               / (max(all_w) - COALESCE(sum(sw) FILTER (is_full), 0))::DOUBLE) ELSE 0.0 END AS l
  FROM filled),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE sw * l END AS target FROM filled, level),
placed AS (
  SELECT d.*, t.source_size, t.target,
    COALESCE(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM keyed d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  (CASE WHEN size > 0 THEN (epochs + CASE WHEN epochs < 3 AND before + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) ELSE 0 END * size)::BIGINT AS taken
FROM placed
"""
