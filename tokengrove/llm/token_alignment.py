"""Alignment of two tokenizers by galloping intersection of their token ends.

Each text is encoded twice, and the byte offsets at which tokens end are two rising lists. The
shorter list drives: an end starts where its share of the longer list would lie, doubles its step
until it has stepped over itself, and is found by binary search in between. All ends of a slice of
texts do so side by side, in arrays. Ends that both lists hold cut both token sequences into groups;
the difference of neighbouring ranks is the range of tokens that a group holds on either side.

Corpus counts are by request and reply: a slice of texts names its distinct linked pairs of ids once,
with the number of its documents that hold each; Spark adds these up per pair, finds the best
counts per first id, and joins them back to the slices that asked. So a pair that every
document holds is one row a slice, its join is salted, and no vocabulary of pairs passes the driver.
A slice asks in requests of a bounded number of links, each with the documents behind every pair, and a
reply is summed per document of its request. So no row grows with a slice, however many a task holds.

Defined cases: texts that are null or empty, or whose tokens do not give back their bytes on both
sides, have no tokens, no groups and a digest of ''. Rows that repeat an id are documents of their own.
A group links its ``m`` and ``n`` tokens in ``m * n`` pairs, which are counted without being listed.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tokengrove.llm.base import opened, ship, size_slices
from tokengrove.llm.trie_bpe import PATTERN, byte_letters
from tokengrove.plans.lineage import cut
from tokengrove.plans.skew import salted_join

#: Bytes of either vocabulary file at most; they travel to the workers.
MOST_FILE_BYTES = 64 << 20
#: Characters that are encoded at a time, and that ask for a pair's count once.
ENCODED, SLICE = 1 << 18, 8 << 20
#: Links of a request, up to its last pair.
LINKS = 1 << 15


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MOST_FILE_BYTES + 1)
    if len(raw) > MOST_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MOST_FILE_BYTES} bytes")
    return raw


class TokenPair:
    """A byte-level and a piece tokenizer; opened once in a worker.

    The byte-level vocabulary runs in a coder of ranks, four times as fast as the library of its file, if both
    agree on the text of every token; that is tried where the pair is made.
    """

    def __init__(self, byte_level: bytes, pieces: bytes):
        self.files = byte_level, pieces
        self.opened = False
        self.ranked = self._agrees()

    def _library(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        first = Tokenizer.from_str(self.files[0].decode())
        first.encode_special_tokens = True
        first.no_truncation()
        first.no_padding()
        return first

    def _coder(self):
        import tiktoken

        vocabulary = json.loads(self.files[0])["model"]["vocab"]
        letters = byte_letters()
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in vocabulary.items() if all(c in letters for c in t)}
        return tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _agrees(self) -> bool:
        definition = json.loads(self.files[0])
        pre = definition.get("pre_tokenizer") or {}
        if definition["model"]["type"] != "BPE" or definition.get("normalizer") or pre.get("type") != "ByteLevel":
            return False
        if pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return False
        try:
            coder, library = self._coder(), self._library()
        except (ImportError, ValueError):
            return False
        probes = [library.decode([i], skip_special_tokens=False) for i in library.get_vocab().values()]
        wanted = [e.ids for e in library.encode_batch(probes, add_special_tokens=False)]
        return [coder.encode_ordinary(p) for p in probes] == wanted

    def open(self) -> TokenPair:
        if self.opened:
            return self
        import sentencepiece

        if self.ranked:
            self.first = self._coder().encode_ordinary
        else:
            library = self._library()
            self.first = lambda text: library.encode(text, add_special_tokens=False).ids
        definition = json.loads(self.files[0])
        letters = byte_letters()
        ids = definition["model"]["vocab"] | {t["content"]: t["id"] for t in definition.get("added_tokens") or ()}
        self.first_bytes = [b""] * (max(ids.values()) + 1)
        for token, id_ in ids.items():
            self.first_bytes[id_] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.second = sentencepiece.SentencePieceProcessor(model_proto=self.files[1])
        self.second_bytes = [
            bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(self.second.id_to_piece(i) for i in range(self.second.get_piece_size()))
        ]
        self.first_sizes, self.second_sizes = (
            np.array([len(b) for b in table], np.int64) for table in (self.first_bytes, self.second_bytes)
        )
        self.names = printed(max(len(self.first_bytes), len(self.second_bytes)))
        self.opened = True
        return self

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids on both sides of texts that both give back; None for the others."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, b in zip(texts, self.second.encode(texts, num_threads=1)):
            a, whole = self.first(" " + text), (" " + text).encode()
            good = b"".join([self.first_bytes[i] for i in a]) == whole and b"".join([self.second_bytes[i] for i in b]) == whole
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if good and text else None)
        return out


def gallop(driver: np.ndarray, longer: np.ndarray, guess: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each end of ``driver`` the first place of ``longer`` in ``[low, high)`` that is not below it, or ``high``.

    From ``guess`` steps double in the direction of the end until it is passed; a binary search
    between the last two steps finds it.
    """
    guess = np.clip(guess, low, high - 1)
    upward = longer[guess] < driver
    # The place is in (below, above]: longer[below] < driver <= longer[above], with open ends.
    below = np.where(upward, guess, low - 1)
    above = np.where(upward, high, guess)
    open_, step = np.arange(len(driver)), 1
    while len(open_):
        up = upward[open_]
        probe = np.where(up, below[open_] + step, above[open_] - step)
        inside = (probe < high[open_]) & (probe >= low[open_])
        open_, probe, up = open_[inside], probe[inside], up[inside]
        less = longer[probe] < driver[open_]
        below[open_[less]] = probe[less]
        above[open_[~less]] = probe[~less]
        open_ = open_[less == up]  # not passed yet
        step *= 2
    open_ = np.flatnonzero(above - below > 1)
    while len(open_):
        middle = (below[open_] + above[open_]) >> 1
        less = longer[middle] < driver[open_]
        below[open_[less]] = middle[less]
        above[open_[~less]] = middle[~less]
        open_ = open_[above[open_] - below[open_] > 1]
    return above


class Aligned:
    """Groups of a slice of texts: tokens of both sides end to end, and where groups and texts stop."""

    def __init__(self, pairs: list[tuple[np.ndarray, np.ndarray]], first_sizes: np.ndarray, second_sizes: np.ndarray):
        self.n = [np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1)]
        self.ids = [np.concatenate([p[k] for p in pairs]) if pairs else np.empty(0, np.int64) for k in (0, 1)]
        # Texts lie end to end, so ends rise over the whole slice and texts share none.
        ends = [np.cumsum(sizes[ids]) for ids, sizes in zip(self.ids, (first_sizes, second_sizes))]
        stop = [np.cumsum(n) for n in self.n]
        start = [s - n for s, n in zip(stop, self.n)]
        drives = self.n[0] <= self.n[1]  # of each text: does the first list drive?
        ranks: list[list[np.ndarray]] = [[], []]
        for k, chosen in ((0, drives), (1, ~drives)):
            texts = np.flatnonzero(chosen)
            n, other = self.n[k][texts], 1 - k
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(start[k][texts], n) + within
            low, high = np.repeat(start[other][texts], n), np.repeat(stop[other][texts], n)
            guess = low + within * (high - low) // np.repeat(np.maximum(n, 1), n)
            found = gallop(ends[k][at], ends[other], guess, low, high)
            hit = found < high
            hit[hit] = ends[other][found[hit]] == ends[k][at[hit]]
            ranks[k].append(at[hit])
            ranks[other].append(found[hit])
        order = np.argsort(np.concatenate(ranks[0]), kind="stable")
        #: One past the last token of each group, on either side.
        self.stop = [np.concatenate(r)[order] + 1 for r in ranks]
        self.text = np.searchsorted(stop[0], self.stop[0] - 1, "right")
        self.sizes = [np.diff(s, prepend=0) for s in self.stop]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``text, code, times``: each text's distinct linked pairs, ``first id << 32 | second id``, and how often."""
        parts = []
        one = self.sizes[0] * self.sizes[1] <= 64
        # Groups of few pairs are listed; in the others ids are counted first, so that runs of one id stay small.
        m, n = self.sizes[0][one], self.sizes[1][one]
        base = [(s - z)[one] for s, z in zip(self.stop, self.sizes)]
        total = m * n
        k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        wide = np.repeat(n, total)
        a = self.ids[0][np.repeat(base[0], total) + k // wide]
        b = self.ids[1][np.repeat(base[1], total) + k % wide]
        parts.append((np.repeat(self.text[one], total), a << 32 | b, np.ones(len(a), np.int64)))
        for g in np.flatnonzero(~one):
            (x, cx), (y, cy) = (
                np.unique(self.ids[s][self.stop[s][g] - self.sizes[s][g] : self.stop[s][g]], return_counts=True) for s in (0, 1)
            )
            rows = max(1, (1 << 20) // len(y))
            for i in range(0, len(x), rows):
                codes = (x[i : i + rows, None] << 32 | y).ravel()
                parts.append((np.full(len(codes), self.text[g]), codes, (cx[i : i + rows, None] * cy).ravel()))
        text, code, times = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((code, text))
        text, code, times = text[order], code[order], times[order]
        heads = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (text[1:] != text[:-1])))) if len(code) else order
        return text[heads], code[heads], np.add.reduceat(times, heads) if len(heads) else times

    def listings(self, names: list[str]) -> Iterator[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``; ``names`` as :func:`printed` gives them."""
        width = len(names) // 4
        (stop_a, stop_b), (size_a, size_b) = self.stop, self.sizes
        # A token of the first side stands behind the second side's tokens of earlier groups, and so on.
        codes = np.empty(len(self.ids[0]) + len(self.ids[1]), np.int64)
        place_a = np.arange(len(self.ids[0])) + np.repeat(stop_b - size_b, size_a)
        place_b = np.arange(len(self.ids[1])) + np.repeat(stop_a, size_b)
        codes[place_a], codes[place_b] = self.ids
        codes[place_a[stop_a - 1]] += width
        last = np.append(self.text[1:] != self.text[:-1], True) if len(self.text) else self.text
        codes[place_b[stop_b - 1]] += np.where(last, 3 * width, 2 * width)
        stops = np.cumsum(self.n[0] + self.n[1]).tolist()
        for start, stop in zip([0, *stops], stops):
            yield "".join(map(names.__getitem__, codes[start:stop].tolist()))


def printed(ids: int) -> list[str]:
    """Ids in decimal, four times: followed by a comma, a bar, a semicolon, nothing."""
    return [f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(ids)]


#: A row for each document, with its place ``_at`` in its slice, and one for each request, with ``_request``.
_ASKED = {
    "_slice": "long", "_at": "int", "_id": "string", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long",
    "groups_sha256": "string", "_request": "int",
    "_codes": "array<long>", "_docs": "array<int>", "_linked": "array<int>", "_times": "array<long>",
}
_ARROW = {
    "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())
}
_SUMS = "_slice long, _at int, n_best long, count_sum long"


def _asked(docs: DataFrame, pair: TokenPair) -> DataFrame:
    """The documents of each slice, and its distinct pairs in requests.

    Of a request ``_docs`` tells in how many of the slice's documents each pair of ``_codes`` is linked;
    ``_linked`` are these documents' places, pair by pair, ``_times`` how often each links it.
    """
    shared = ship(docs.sparkSession, pair)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, rows = batch.columns
            sizes = pc.utf8_length(texts).to_numpy()
            for start, stop in size_slices(sizes.tolist(), SLICE):
                key, n = rows[start].as_py(), stop - start
                found, requests = _slice_rows(opened(shared).open(), texts.slice(start, n), sizes[start:stop])
                places = np.arange(n, dtype=np.int32)
                yield _filled(n, _slice=np.full(n, key), _at=places, _id=ids.slice(start, n), **found)
                n = len(requests["_codes"])
                yield _filled(n, _slice=np.full(n, key), _request=np.arange(n, dtype=np.int32), **requests)
                del found, requests
            del batch, ids, texts, rows
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in _ASKED.items()))


def _filled(n: int, **columns) -> pa.RecordBatch:
    """``n`` rows of ``_ASKED`` with these columns, nulls in the others."""
    arrays = []
    for name, kind in _ASKED.items():
        values = columns.get(name, pa.nulls(n, _ARROW[kind]))
        arrays.append(values if isinstance(values, pa.Array) else pa.array(values, _ARROW[kind]))
    return pa.RecordBatch.from_arrays(arrays, names=[*_ASKED])


def _slice_rows(pair: TokenPair, texts: pa.Array, sizes: np.ndarray) -> tuple[dict, dict]:
    """Columns of a slice's documents and of its requests."""
    counts, digests = np.zeros((4, len(texts)), np.int64), [""] * len(texts)
    parts: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64))]
    for start, stop in size_slices(sizes.tolist(), ENCODED):
        encoded = pair.encode(texts.slice(start, stop - start).to_pylist())
        good = np.flatnonzero([e is not None for e in encoded])
        if not len(good):
            continue
        aligned = Aligned([encoded[i] for i in good], pair.first_sizes, pair.second_sizes)
        text, code, often = aligned.links()
        links = np.zeros(len(good), np.int64)
        np.add.at(links, text, often)
        groups = np.bincount(aligned.text, minlength=len(good))
        counts[:, start + good] = np.stack([*aligned.n, groups, links])
        for i, listing in zip(good, aligned.listings(pair.names)):
            digests[start + i] = hashlib.sha256(listing.encode()).hexdigest()
        parts.append((code, (start + good[text]).astype(np.int32), often))
    documents = dict(zip(("n_a", "n_b", "n_groups", "n_links"), counts), groups_sha256=digests)
    code, linked, times = map(np.concatenate, zip(*parts))
    parts.clear()
    order = np.argsort(code, kind="stable")  # documents rise within a pair
    code, linked, times = code[order], linked[order], times[order]
    heads = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else order
    docs = np.diff(np.append(heads, len(code))).astype(np.int32)
    # Of the pairs, those with which a request begins.
    begins = np.flatnonzero(np.diff(heads // LINKS, prepend=-1))
    per_pair, per_link = np.append(begins, len(heads)), np.append(heads[begins], len(code))
    arrays = ("_codes", code[heads], per_pair), ("_docs", docs, per_pair), ("_linked", linked, per_link), ("_times", times, per_link)
    return documents, {n: pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(v)) for n, v, stops in arrays}


def pair_counts(asked: DataFrame) -> DataFrame:
    """``_code, _n, _best``: in how many documents a pair is linked, and whether no pair of its first id is in more."""
    counted = cut(
        asked.select(F.explode(F.arrays_zip("_codes", "_docs")).alias("_p"))
        .groupBy(F.col("_p._codes").alias("_code"))
        .agg(F.sum("_p._docs").alias("_n"))
    )
    first = F.shiftright("_code", 32)
    most = counted.groupBy(first.alias("_a")).agg(F.max("_n").alias("_most"))
    return (
        counted.withColumn("_a", first)
        .join(most, "_a")
        .select("_code", "_n", (F.col("_n") == F.col("_most")).alias("_best"))
    )


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``n_best`` and ``count_sum`` of each document of a request, as far as its pairs go."""
    for batch in batches:
        slices = batch.column(0).to_numpy()
        docs, linked, times, n, best = (
            (c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in batch.columns[1:]
        )
        for i in range(batch.num_rows):
            of = [values[stops[i] : stops[i + 1]] for stops, values in (docs, linked, times, n, best)]
            sums = np.zeros((2, int(of[1].max(initial=-1)) + 1), np.int64)
            np.add.at(sums[0], of[1], of[2] * np.repeat(of[4].astype(np.int64), of[0]))
            np.add.at(sums[1], of[1], of[2] * np.repeat(of[3], of[0]))
            at = np.unique(of[1])
            columns = np.full(len(at), slices[i]), at, sums[0][at], sums[1][at]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["_slice", "_at", "n_best", "count_sum"])


def align_tokens(
    docs: DataFrame, byte_level_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    pair = TokenPair(_file(byte_level_path), _file(pieces_path))
    # Ids travel as text: a null among long ones would turn them to floating point in pandas.
    rows = docs.select(
        F.col(id_col).cast("string").alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.monotonically_increasing_id().alias("_row"),
    )
    asked = cut(_asked(rows, pair))
    requests = asked.where(F.col("_request").isNotNull())
    wanted = requests.select("_slice", "_request", F.posexplode("_codes").alias("_place", "_code"))
    key = ["_slice", "_request"]
    replies = (
        salted_join(wanted, cut(pair_counts(requests)), ["_code"], "inner", key)
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("_place", "_n", "_best"))).alias("_r"))
        .select(*key, F.col("_r._n").alias("_n"), F.col("_r._best").alias("_best"))
    )
    sums = (
        requests.select(*key, "_docs", "_linked", "_times")
        .join(replies, key)
        .select("_slice", "_docs", "_linked", "_times", "_n", "_best")
        .mapInArrow(_totals, _SUMS)
        .groupBy("_slice", "_at")
        .agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    )
    found = asked.where(F.col("_request").isNull()).join(sums, ["_slice", "_at"], "left")
    return found.select(
        F.col("_id").cast("long").alias("doc_id"),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")],
        "groups_sha256",
    )
