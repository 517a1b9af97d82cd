"""Spelling variants by a bit-sliced position index.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Let
``m`` be the shorter length: near words agree in their first ``m // 2`` code points or in their last
``m - m // 2``, so they meet under one of the keys that each word is dealt to for its own length
and for one less. A block is the words of some keys. Its index holds, for each position and
letter, the bitset of the block's words that have that letter there; words stand in the index in order of
falling count. All words of the block run through it side by side. After ``i`` letters four sets are kept:

    exact      the words that begin with the same ``i`` letters
    replaced   those that differ in one of them             (next letter at position ``i``)
    shorter    those that lack one of them                  (position ``i - 1``)
    longer     those that have one more                     (position ``i + 1``)

Each is the last one masked by the bitset of the next letter, or entered from ``exact``. Pairs that agree
in the first half count under that key only, so each is found once. A bitset's population is
``n_near`` and its lowest bit the near word of largest count.

Skew: a key above ``BLOCK`` words is cut by a hash of the word, and every two cuts are a block of their own:
the words of one cut run through the index of the other, so no task holds a key. Runs are counted before
they are shuffled. Forms are followed by pointer doubling; a form is at least twice as frequent, so rounds
grow with the logarithm of the logarithm of the largest count.

Defined cases: null and empty texts have no runs; a null id counts as no characters before the colon.
Repeated rows count each. Without words of ``LEAST_LENGTH`` and ``LEAST_COUNT`` there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tokengrove.plans.lineage import cut
from tokengrove.plans.skew import salted_join

#: Fixed values of the contract: runs, deletions, words.
RUN = "([A-Za-zÀ-ÿ]+)"
DELETES, LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 97, 5, 3, 2
#: Words of a block: an index holds at most so many, small keys are put together up to the other.
BLOCK, PACKED = 4096, 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: runs in lower case, some with a code point deleted by rule, that are long and frequent enough."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all(F.translate(F.col(text_col), _UPPER, _LOWER), F.lit(RUN), F.lit(1))).alias("_run"),
    ).where(F.length("_run") >= LEAST_LENGTH)  # a deletion never makes a run longer
    hashed = runs.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")))
    at = (F.col("_h") % F.length("_run")).cast("int")
    shorter = F.concat(F.col("_run").substr(F.lit(1), at), F.col("_run").substr(at + 2, F.length("_run")))
    word = F.when(F.col("_h") % DELETES == 0, shorter).otherwise(F.col("_run"))
    return (
        hashed.groupBy(word.alias("word"))
        .agg(F.count("*").alias("n"))
        .where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))
    )


def _keyed(words: DataFrame) -> DataFrame:
    """``word, n, _m, _front, _key``: each word under the halves of its length and of one less."""

    def halves(m):
        half = (m / 2).cast("int")
        return (
            F.struct(m.alias("_m"), F.lit(True).alias("_front"), F.col("word").substr(F.lit(1), half).alias("_key")),
            F.struct(
                m.alias("_m"),
                F.lit(False).alias("_front"),
                F.col("word").substr(F.length("word") - (m - half) + 1, m - half).alias("_key"),
            ),
        )

    size = F.length("word")
    return words.select("word", "n", F.explode(F.array(*halves(size), *halves(size - 1))).alias("_k")).select(
        "word", "n", "_k.*"
    )


def _blocks(words: DataFrame) -> DataFrame:
    """Rows of :func:`_keyed` with the block they belong to, as member of the index, as one that runs through it, or both."""
    key = ["_m", "_front", "_key"]
    keyed = _keyed(words)
    large = keyed.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK)
    large = cut(large.select(*key, F.ceil(F.col("_n") / F.lit(BLOCK)).cast("int").alias("_cuts")))
    sized = salted_join(keyed, large, key, "left", ["word"])
    own = F.pmod(F.xxhash64("word"), F.col("_cuts")).cast("int")
    others = F.sequence(F.lit(0), F.col("_cuts") - 1)
    roles = F.when(
        F.col("_cuts").isNull(),
        F.array(F.struct(F.lit(0).alias("_index"), F.lit(0).alias("_query"), F.lit(3).alias("_role"))),
    ).otherwise(
        F.concat(
            F.transform(others, lambda q: F.struct(own.alias("_index"), q.alias("_query"), F.lit(1).alias("_role"))),
            F.transform(others, lambda i: F.struct(i.alias("_index"), own.alias("_query"), F.lit(2).alias("_role"))),
        )
    )
    return sized.select("word", "n", *key, F.explode(roles).alias("_r"), F.col("_cuts").isNotNull().alias("_cut")).select(
        "word", "n", *key, "_cut", "_r.*"
    )


def _letters(words: list[str], width: int) -> np.ndarray:
    """Code points of words, a row each; 0 behind the end."""
    flat = np.frombuffer("".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(words), width)


class PositionIndex:
    """Bitsets of the words that have a letter at a position, made when a position is asked for."""

    def __init__(self, words: list[str], width: int):
        self.words = -(-len(words) // 64)
        self.letters = np.zeros((64 * self.words, width), np.uint32)
        self.letters[: len(words)] = _letters(words, width)
        self.size = np.array([len(w) for w in words] + [0] * (64 * self.words - len(words)))
        self.empty = np.zeros((1, self.words), np.uint64)

    def pack(self, rows: np.ndarray) -> np.ndarray:
        return np.packbits(rows, axis=-1, bitorder="little").view(np.uint64)

    def at(self, position: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted letters of a position and a bitset for each; behind them an empty one."""
        if not 0 <= position < self.letters.shape[1]:
            return np.empty(0, np.uint32), self.empty
        column = self.letters[:, position]
        letters = np.unique(column)
        letters = letters[letters > 0]
        if not len(letters):
            return letters, self.empty
        return letters, np.concatenate((self.pack(column == letters[:, None]), self.empty))


def _masks(held: tuple[np.ndarray, np.ndarray], letters: np.ndarray) -> np.ndarray:
    """The bitset of each query's letter."""
    known, bits = held
    if not len(known):
        return bits[np.zeros(len(letters), np.int64)]
    at = np.minimum(np.searchsorted(known, letters), len(known) - 1)
    return bits[np.where(known[at] == letters, at, len(known))]


def near_sets(index: PositionIndex, queries: list[str], m: int, front: bool) -> np.ndarray:
    """For each query the bitset of near words: those whose shorter length is ``m``, and that agree, or not, in the first half."""
    letters = _letters(queries, m + 1)
    exact = np.broadcast_to(index.pack(index.size > 0), (len(queries), index.words)).copy()
    replaced, shorter, longer = (np.zeros_like(exact) for _ in range(3))
    half = exact if m // 2 == 0 else None
    before, here, after = index.at(-1), index.at(0), index.at(1)
    of_m = None
    for i in range(m + 1):
        letter = letters[:, i]
        same, ahead = _masks(here, letter), _masks(after, letter)
        shorter = (shorter & _masks(before, letter)) | exact
        if i == m:  # only queries of m + 1 letters are left, near to words that lack one
            break
        replaced = (replaced & same) | (exact & ~same & index.pack(index.size > i))
        longer = (longer | exact) & ahead
        exact = exact & same
        if i + 1 == m // 2:
            half = exact
        before, here, after = here, after, index.at(i + 2)
        if i + 1 == m:
            of_m = (replaced & index.pack(index.size == m)) | ((longer | exact) & index.pack(index.size == m + 1))
    sizes = np.array([len(q) for q in queries])[:, None]
    found = np.where(sizes == m, of_m, shorter & index.pack(index.size == m))
    return found & (half if front else ~half)


def near_words(words: list[str], counts: np.ndarray, roles: np.ndarray, m: int, front: bool) -> pd.DataFrame | None:
    """``word, near, best_n, best`` of the queries of a block that have near words in its index."""
    members = sorted([i for i in range(len(words)) if roles[i] & 1], key=lambda i: (-counts[i], words[i]))
    queries = [i for i in range(len(words)) if roles[i] & 2]
    if not members or not queries:
        return None
    found = near_sets(PositionIndex([words[i] for i in members], m + 1), [words[i] for i in queries], m, front)
    near = np.bitwise_count(found).sum(axis=1).astype(np.int64)
    at = np.flatnonzero(near)
    if not len(at):
        return None
    found = found[at]
    first = np.argmax(found != 0, axis=1)
    word = found[np.arange(len(at)), first]
    lowest = np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1))
    best = [members[i] for i in (64 * first + lowest).tolist()]
    return pd.DataFrame(
        {
            "word": [words[queries[i]] for i in at],
            "near": near[at],
            "best_n": counts[best],
            "best": [words[i] for i in best],
        }
    )


def near_counts(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best``: of every word that has near words their number and the most frequent of them."""
    key = ["_m", "_front", "_key", "_index", "_query"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            # The last key may go on in the next batch.
            keys = rest[key]
            last = (keys != keys.iloc[-1]).any(axis=1).to_numpy()
            stop = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if stop:
                yield from _packed(rest.iloc[:stop], key)
                rest = rest.iloc[stop:]
        if rest is not None and len(rest):
            yield from _packed(rest, key)

    found = (
        _blocks(words)
        .repartition(*key)
        .sortWithinPartitions(*key)
        .mapInPandas(run, "word string, near long, best_n long, best string")
    )
    return (
        found.groupBy("word")
        .agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("_n"), "best")).alias("_b"))
        .select("word", "n_near", (-F.col("_b._n")).alias("best_n"), "_b.best")
    )


def _packed(rows: pd.DataFrame, key: list[str]) -> Iterator[pd.DataFrame]:
    """Whole keys, put together to blocks of one ``m`` and side."""
    keys = rows[key]
    new = (keys != keys.shift()).any(axis=1).to_numpy()
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    rows = rows[(size > 1)[group]]
    group = group[(size > 1)[group]]
    if not len(rows):
        return
    m, front, apart = (rows[c].to_numpy() for c in ("_m", "_front", "_cut"))
    words, counts, roles = rows["word"].to_numpy(), rows["n"].to_numpy(), rows["_role"].to_numpy()
    starts = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(rows)]
    begin = 0
    for low, high in zip(starts, starts[1:]):
        end = starts[-1] == high
        if not end:
            end = high - begin >= PACKED or apart[low] or apart[high] or m[high] != m[low] or front[high] != front[low]
        if end:
            found = near_words(list(words[begin:high]), counts[begin:high], roles[begin:high], int(m[begin]), bool(front[begin]))
            if found is not None:
                yield found
            begin = high


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words that have a ``form``, by doubling the way."""
    state = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        up = state.select(F.col("word").alias("_word"), F.col("root").alias("_up"))
        state = cut(
            state.join(up, F.col("root") == F.col("_word"), "left").select(
                "word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")
            )
        )
        if not state.where("_moved").limit(1).count():
            return state.select("word", "root")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the texts."""
    words = cut(word_counts(docs, id_col, text_col))
    formed = F.col("best_n") >= FORM_RATIO * F.col("n")
    near = cut(
        words.join(near_counts(words), "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("best")).alias("form"),
            F.when(formed, F.col("best_n")).alias("form_n"),
        )
    )
    roots = _roots(near.where(F.col("form").isNotNull()).select("word", "form"))
    return near.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


ORACLE = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents),
counted AS (
  SELECT run, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x
  FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (
  SELECT run, k, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(x) // 2), lambda i:
      CAST(16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1 AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM counted, crc),
written AS (
  SELECT k, CASE WHEN h % 97 = 0
    THEN substring(run, 1, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2)
    ELSE run END AS word
  FROM hashed),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM written WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
spots AS (SELECT word, n, unnest(range(length(word))) AS p FROM words),
cuts AS (SELECT word, n, p, substring(word, 1, p) || substring(word, p + 2) AS s FROM spots),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN words b ON a.s = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.s = b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN cuts b ON a.p = b.p AND a.s = b.s AND a.word <> b.word),
best AS (
  SELECT word, count(*) AS n_near, max(m) AS form_n, arg_min(other, (-m, encode(other))) AS form FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
way AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL SELECT way.word, f.form, step + 1 FROM way JOIN formed f ON f.word = way.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM formed f JOIN (SELECT word, arg_max(root, step) AS root FROM way GROUP BY word) r USING (word)
"""
