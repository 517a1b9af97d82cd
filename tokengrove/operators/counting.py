"""Token counts of files and of whole prompts.

A prompt is counted in parts, but a pre-token may span two of them. So each part hands on its tail,
the text from a pre-token's start near its end, and counts its own text behind the tail it is handed.
Where a tail may start depends on the parts before: splitting from a few places close to the end
finds the candidates, almost always one. Each part then maps every candidate it may be
handed to one of its own, by splitting the whole; such maps compose, so the way through the candidates
is found by doubling. Only a part that a single pre-token fills has no candidate and is joined with the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tokengrove.functions.tokens import Tokenizer, bpe_tokens, merged_tokens, pretokens
from tokengrove.operators.render import ORDER
from tokengrove.plans.assemble import assemble, write_pieces
from tokengrove.plans.lineage import cut
from tokengrove.plans.slices import ranked, running

COUNT_BYTES = 2 << 20
#: A tail has at least so many characters: more than any pattern looks ahead, and no special token is longer.
MARGIN = 32
#: Candidates come from the last characters of a part, split from so many starts (numbers are split by threes).
NEAR_END, STARTS = 4096, 3

NODE = ["repo", "_no", "_k"]


def count_files(files: DataFrame, tokenizer: Tokenizer, content: str = "content") -> DataFrame:
    """``files`` with ``tokens`` counted on the raw text."""
    return files.withColumn("tokens", bpe_tokens(files.sparkSession, F.col(content), tokenizer))


def _tails(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``repo, part, _own``: where a tail may start, ``array<struct<n, size, carry>>``: its pieces, characters and text."""
    margin = max([MARGIN, *(len(s) + 4 for s in tokenizer.specials)])

    def candidates(endings: DataFrame) -> DataFrame:
        """Of ``(repo, part, _of)`` the last start far enough from the end, of splits from each of the first places."""
        starts = F.explode(F.array(*[F.substring("_of", F.lit(1 + k), F.length("_of")) for k in range(STARTS)]))
        split = endings.select("repo", "part", starts.alias("_of")).withColumn(
            "_last", F.slice(F.reverse(pretokens(F.col("_of"), tokenizer)), 1, margin)
        )
        nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"))
        tail = F.aggregate(
            "_last",
            nothing,
            lambda t, p: F.when(t["size"] >= margin, t).otherwise(
                F.struct((t["n"] + 1).alias("n"), (t["size"] + F.length(p)).alias("size"))
            ),
        )
        found = split.select("repo", "part", "_of", tail.alias("_t")).where(
            (F.col("_t.size") >= margin) & (F.col("_t.size") < F.length("_of"))
        )
        carry = F.right("_of", F.col("_t.size"))
        one = F.struct(F.col("_t.n").alias("n"), F.col("_t.size").alias("size"), carry.alias("carry"))
        return found.groupBy("repo", "part").agg(F.array_sort(F.collect_set(one)).alias("_own"))

    near = cut(candidates(texts.select("repo", "part", F.right("text", F.lit(NEAR_END)).alias("_of"))))
    rest = texts.where(F.length("text") > NEAR_END).join(near, ["repo", "part"], "left_anti")
    far = candidates(rest.select("repo", "part", F.col("text").alias("_of")))
    none = F.array().cast(near.schema["_own"].dataType)
    return texts.select("repo", "part").join(near.unionByName(far), ["repo", "part"], "left").withColumn(
        "_own", F.coalesce("_own", none)
    )


def _steps(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``repo, part, _no, _k, _ways, _out, _end, tokens``: a part's own tokens when it is handed candidate ``_k``
    of ``_ways``, and the candidate it hands on; null if none of its own starts where a pre-token does."""
    tails = cut(_tails(texts, tokenizer))
    placed = ranked(tails, ["repo"], [F.col("part")], "_no")
    placed = cut(placed)
    handed = placed.select("repo", (F.col("_no") + 1).alias("_no"), F.col("_own.carry").alias("_in"))
    more = placed.select("repo", (F.col("_no") - 1).alias("_no"), F.lit(False).alias("_end"))
    links = placed.join(handed, ["repo", "_no"], "left").join(more, ["repo", "_no"], "left")
    ways = F.when(F.size("_in") > 0, F.col("_in")).otherwise(F.array(F.lit("")))
    links = links.select(
        "repo", "part", "_no", "_own", F.coalesce("_end", F.lit(True)).alias("_end"), ways.alias("_in")
    )
    split = (
        texts.join(links, ["repo", "part"])
        .select("*", F.posexplode("_in").alias("_k", "_carry"))
        .withColumn("_pieces", pretokens(F.concat("_carry", "text"), tokenizer))
    )

    def characters(n: Column) -> Column:
        return F.aggregate(F.slice(F.col("_pieces"), -n, n), F.lit(0), lambda s, p: s + F.length(p))

    fits = F.filter(
        F.transform("_own", lambda t, k: F.struct(k.alias("k"), t["n"].alias("n"), t["size"].alias("size"))),
        lambda t: characters(t["n"]) == t["size"],
    )
    chosen = split.withColumn("_fit", F.get(fits, F.lit(0)))
    kept = F.size("_pieces") - F.when(F.col("_end"), 0).otherwise(F.coalesce("_fit.n", F.lit(0)))
    return chosen.select(
        "repo",
        "part",
        "_no",
        "_k",
        F.size("_in").alias("_ways"),
        F.col("_fit.k").alias("_out"),
        "_end",
        merged_tokens(texts.sparkSession, F.slice("_pieces", F.lit(1), kept), tokenizer).alias("tokens"),
    )


def _way(steps: DataFrame) -> DataFrame:
    """The steps that are taken: a part that can be handed one tail only is one, and leads on."""
    if steps.where("_ways > 1").isEmpty():
        return steps
    known = cut(steps.where("_ways = 1").select(*NODE))
    jumps = steps.where(F.col("_out").isNotNull() & ~F.col("_end")).select(
        *NODE, (F.col("_no") + 1).alias("_to"), F.col("_out").alias("_to_k")
    )
    while True:
        led = known.join(jumps, NODE).select("repo", F.col("_to").alias("_no"), F.col("_to_k").alias("_k"))
        fresh = cut(led.distinct().join(known, NODE, "left_anti"))
        if fresh.isEmpty():
            return steps.join(known, NODE, "left_semi")
        known = cut(known.unionByName(fresh))
        further = jumps.select(
            "repo", F.col("_no").alias("_to"), F.col("_k").alias("_to_k"), F.col("_to").alias("_next"), F.col("_to_k").alias("_next_k")
        )
        jumps = cut(
            jumps.join(further, ["repo", "_to", "_to_k"]).select(
                *NODE, F.col("_next").alias("_to"), F.col("_next_k").alias("_to_k")
            )
        )


def _joined(texts: DataFrame, steps: DataFrame, stuck: DataFrame) -> DataFrame:
    """``texts`` with every other part of a run of stuck ones joined with the next."""
    parts = steps.select("repo", "part", "_no").distinct().join(
        stuck.select("repo", "part", F.lit(0).alias("_free")), ["repo", "part"], "left"
    )
    runs = running(parts, ["repo"], [F.col("part")], {"_run": F.coalesce("_free", F.lit(1))})
    first = runs.groupBy("repo", "_run").agg(F.min("_no").alias("_first"))
    pair = F.floor((F.col("_no") - F.col("_first")) / 2)
    pairs = runs.join(first, ["repo", "_run"]).select("repo", "part", "_run", pair.alias("_pair"))
    both = F.array_sort(F.collect_list(F.struct("part", "text")))
    return (
        texts.join(pairs, ["repo", "part"])
        .groupBy("repo", "_run", "_pair")
        .agg(F.min("part").alias("part"), F.array_join(F.transform(both, lambda p: p["text"]), "").alias("text"))
        .select("repo", "part", "text")
    )


def prompt_tokens(
    pieces: DataFrame, tokenizer: Tokenizer, part_bytes: int = COUNT_BYTES
) -> DataFrame:
    """Tokens of each whole trimmed prompt, from the pieces :func:`all_pieces` gives.

    The count is that of the undivided prompt, whatever ``part_bytes``. The pattern of ``tokenizer``
    must match every character, as the published ones do.
    """
    rows = write_pieces(pieces, ["repo"], ORDER)
    sizes = rows.groupBy("repo").agg(F.sum("_bytes").alias("_size"))
    texts = assemble(rows, ["repo"], ORDER, part_bytes, trim=True, written=True, count=True)
    if sizes.where(F.col("_size") > part_bytes).isEmpty():  # no prompt is in parts
        return texts.select("repo", bpe_tokens(rows.sparkSession, F.col("text"), tokenizer).alias("tokens"))
    texts = cut(texts)
    whole = texts.where("parts = 1").select(
        "repo", bpe_tokens(rows.sparkSession, F.col("text"), tokenizer).alias("tokens")
    )
    texts = texts.where("parts > 1").select("repo", "part", "text")
    while True:
        steps = cut(_steps(texts, tokenizer))
        way = _way(steps)
        stuck = cut(way.where(F.col("_out").isNull() & ~F.col("_end")).select("repo", "part"))
        if stuck.isEmpty():
            return whole.unionByName(way.groupBy("repo").agg(F.sum("tokens").alias("tokens")))
        texts = cut(_joined(texts, steps, stuck))
