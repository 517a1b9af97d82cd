"""Chat formatting: every participant's perspective of a multi-party dialogue.

A participant is a role that speaks in the conversation, apart from ``system``. For each, the
dialogue is rendered with that speaker as ``assistant``, every other as ``user`` with its name,
and system turns as they are; the mask marks the speaker's own words, which are what
is trained on. Only DataFrame functions are used.

Rendering: ``<|im_start|>ROLE name=NAME\\nTEXT<|im_end|>\\n`` for each turn, ``name`` for users only.
The mask is the list of ``[start, end)`` code-point spans of the texts, each with its closing
mark, within the part.

Scale: a conversation is not collected. Its rendered turns are pieces that are placed by
running byte sums over range slices and joined to parts of at most ``part_bytes`` and one
turn; a dialogue below that is one part, 0, and the parts of a longer one concatenate to the
whole. Each turn is read once for every participant, which the result holds too.

Defined cases: a null text is empty; a null role is the participant ``unknown``; null turns come
last but are kept; equal turns are ordered by role, then text, and repeated rows are rendered as
often as they come. A conversation of system turns alone has no participant and no row. Null
conversation ids are one conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tokengrove.plans.lineage import cut
from tokengrove.plans.slices import running

PART_BYTES = 16 * 1024 * 1024
SYSTEM, UNKNOWN = "system", "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rotate(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``conv_id, participant, part, n_turns, n_trained, text, mask``, one row per part.

    ``n_turns`` counts the turns of the part, ``n_trained`` those of its own speaker, ``mask`` is an
    array of ``struct(start, end)``.
    """
    said = cut(
        turns.select(
            F.col(conv_col).alias("conv_id"),
            # A name for every conversation, null too, that can be joined on.
            F.coalesce(F.concat(F.lit("c"), F.col(conv_col).cast("string")), F.lit("n")).alias("_conv"),
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col), F.lit(UNKNOWN)).alias("speaker"),
            F.coalesce(F.col(text_col), F.lit("")).alias("said"),
        )
    )
    people = (
        said.where(F.col("speaker") != SYSTEM)
        .select("_conv", F.col("speaker").alias("participant"))
        .distinct()
    )
    # Participants of a conversation meet its turns: as many rows as the result renders.
    seen = said.join(people, "_conv")
    own = F.col("speaker") == F.col("participant")
    head = (
        F.when(own, F.lit("assistant\n"))
        .when(F.col("speaker") == SYSTEM, F.lit(SYSTEM + "\n"))
        .otherwise(F.concat(F.lit("user name="), F.col("speaker"), F.lit("\n")))
    )
    pieces = seen.select(
        "_conv",
        "conv_id",
        "participant",
        F.col("turn").isNull().alias("_late"),
        "turn",
        "speaker",
        "said",
        own.alias("_own"),
        F.concat(F.lit(OPEN), head).alias("_head"),
    )
    # What is rendered around a text is short: texts move without it.
    end = len(CLOSE) + 1
    order = ["_late", "turn", "speaker", "said"]
    placed = running(
        pieces,
        ["_conv", "participant"],
        [F.col(c) for c in order],
        {
            "_at": F.octet_length("_head") + F.octet_length("said") + end,
            "_from": F.length("_head") + F.length("said") + end,
            "_n": F.lit(1),
        },
    ).withColumn("part", F.floor(F.col("_at") / F.lit(part_bytes)).cast("long"))
    start = F.col("_from") + F.length("_head")
    grouped = placed.groupBy("_conv", "conv_id", "participant", "part").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "_n",
                    F.concat("_head", "said", F.lit(CLOSE + "\n")).alias("text"),
                    F.col("_own").alias("own"),
                    start.alias("start"),
                    (start + F.length("said") + F.lit(len(CLOSE))).alias("end"),
                )
            )
        ).alias("_pieces"),
        F.min("_from").alias("_first"),
        F.count("*").alias("n_turns"),
        F.sum(F.col("_own").cast("long")).alias("n_trained"),
    )
    first = F.col("_first")
    return grouped.select(
        "conv_id",
        "participant",
        "part",
        "n_turns",
        "n_trained",
        F.array_join(F.transform("_pieces", lambda p: p["text"]), "").alias("text"),
        F.transform(
            F.filter("_pieces", lambda p: p["own"]),
            lambda p: F.struct(
                (p["start"] - first).cast("long").alias("start"), (p["end"] - first).cast("long").alias("end")
            ),
        ).alias("mask"),
    )


def rotated_digests(turns: DataFrame, **options) -> DataFrame:
    """:func:`rotate` with the mask as text, ``start-end`` separated by commas."""
    return rotate(turns, **options).withColumn(
        "mask",
        F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"])), ","),
    )


ORACLE = """
WITH said AS (
  SELECT conv_id, turn, COALESCE(role, 'unknown') AS speaker, COALESCE(text, '') AS said FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS participant FROM said WHERE speaker <> 'system'),
pieces AS (
  SELECT s.conv_id, participant, turn, speaker, said, speaker = participant AS own,
    '<|im_start|>' || CASE WHEN speaker = participant THEN 'assistant' WHEN speaker = 'system' THEN 'system'
      ELSE 'user name=' || speaker END || chr(10) AS head
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
spans AS (
  SELECT *, head || said || '<|im_end|>' || chr(10) AS piece,
    row_number() OVER o AS n,
    COALESCE(sum(len(head || said || '<|im_end|>' || chr(10))) OVER
      (PARTITION BY conv_id, participant ORDER BY turn NULLS LAST, speaker, said
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + len(head) AS start
  FROM pieces WINDOW o AS (PARTITION BY conv_id, participant ORDER BY turn NULLS LAST, speaker, said))
SELECT conv_id, participant, 0::BIGINT AS part, count(*)::BIGINT AS n_turns, (count(*) FILTER (own))::BIGINT AS n_trained,
  string_agg(piece, '' ORDER BY n) AS text,
  string_agg(CAST(start AS BIGINT)::VARCHAR || '-' || CAST(start + len(said) + 10 AS BIGINT)::VARCHAR, ',' ORDER BY n) FILTER (own) AS mask
FROM spans GROUP BY conv_id, participant
"""
