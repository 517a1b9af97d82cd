"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Features: shingles of five lower-cased words; the i-th occurrence of a shingle is a feature of
its own, so the weighted Jaccard similarity of ``tf * idf`` vectors is that of the feature sets
weighted by idf alone. ``idf`` is ``ln(1 + N / df)`` over its largest value, where df below ``COMMON`` of
the documents counts as ``COMMON``: only common shingles need their df. It is not damped (``DAMP``
is 1: all of the idf counts). Near copies would raise the df of what they share, so that the few changed words
of copies in a large group outweigh all that is equal and the group falls apart. So a large group counts
as one document: a group is the documents of one value of a short unweighted sketch, large from ``LARGE`` of the
documents and ``LEAST`` of them on, and each of its ``m`` documents counts as ``1 / m``. There are at most
``SKETCHES / LARGE`` such values at any corpus size; smaller groups hardly move a df of ``COMMON``. Common shingles
are found exactly over all documents in two passes: a shingle that is common in the corpus is
common in at least one segment of it (documents weighted alike), so segments name candidates, and a second pass counts
these. There are at most ``mean shingles / COMMON`` common shingles at any corpus size, which bounds
what is broadcast.

Sampling (Ioffe 2010): with r, c ~ Gamma(2, 1), beta ~ U(0, 1) of a feature and a hash function,
``t = floor(ln w / r + beta)``, ``ln a = ln c - r (t - beta) - r``; the sample is the (feature, t) of
the smallest a. The draws come from a table of 2^16 triples that feature and hash function index.
``BANDS`` bands of ``ROWS`` samples: a pair at 0.8 shares a band with probability 0.998.

Verification is exact and loses no link between documents that share a band: every document of
a bucket is compared with its smallest id first, which settles true groups of any size with one
comparison a document; in buckets that then still hold several components, all documents of
different components are compared, in blocks of ``BLOCK`` that no hot bucket exceeds. Buckets with
the same documents count once.

Defined cases: equal texts are one class, found by digest. Null texts and rows without an id are
alone (class: own id). Texts without a word link only with equal texts; below five words the
whole text is one shingle. Rows that share an id are one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tokengrove.llm.base import opened, ship, text_slices
from tokengrove.llm.components import connected_components
from tokengrove.plans.lineage import cut

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 4
COMMON, DAMP = 0.01, 1.0
#: Large groups of near copies: by values of so many sketches of so many smallest hashes each.
SKETCHES, SKETCH_ROWS, LARGE, LEAST = 6, 3, 0.001, 64
BLOCK = 128
#: Shingles of one segment of the first pass, and candidates counted in one round of the second.
SEGMENT, ROUND = 2_000_000, 2_000_000
DRAWS, SEED = 1 << 16, 7

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_POWERS = np.cumprod(np.full(64, 0x100000001B3, dtype=np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of each text, repeats included, one after the other; and their counts."""
    raw = [(t or "").lower().encode("utf-8", "replace") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    inside = _INSIDE[data]
    at = np.flatnonzero(inside)
    sizes = np.zeros(len(raw), np.int64)
    if not len(at):
        return np.zeros(0, np.uint64), sizes
    first = np.flatnonzero(~np.concatenate(([False], inside[:-1]))[at])
    lengths = np.diff(np.append(first, len(at)))
    place = (np.arange(len(at)) - np.repeat(first, lengths)) & 63
    words = _mix(np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place], first) + lengths.astype(np.uint64) * _C)
    ends = np.cumsum([len(r) for r in raw])
    counts = np.bincount(np.searchsorted(ends, at[first], side="right"), minlength=len(raw))
    out, start = [], 0
    for i, n in enumerate(counts):
        w = words[start : start + n]
        start += n
        if n:
            k = min(WORDS, n)
            s = w[: n - k + 1].copy()
            for j in range(1, k):
                s = s * _A + w[j : n - k + 1 + j]
            s = _mix(s)
            s.sort()
            out.append(s)
            sizes[i] = len(s)
    return np.concatenate(out), sizes


def occurrences(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often the same hash came before in its text (hashes sorted per text)."""
    at = np.arange(len(hashes))
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    begins = np.cumsum(sizes) - sizes
    new[begins[sizes > 0]] = True
    return at - np.maximum.accumulate(np.where(new, at, 0))


class Weights:
    """idf of shingles: a sorted array of the common ones, all others weigh the most."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, documents: float):
        order = np.argsort(hashes)
        self.hashes = hashes[order].astype(np.uint64)
        self.most = 1.0
        share = np.log1p(documents / df[order]) / math.log1p(1 / COMMON)
        self.idf = 1 - DAMP * (1 - np.minimum(share, 1.0))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        weights = np.full(len(hashes), self.most)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            weights[hit] = self.idf[at[hit]]
        return weights

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted features of a text and their weights."""
        hashes, sizes = shingles([text])
        f = _mix(hashes + occurrences(hashes, sizes).astype(np.uint64) * _C)
        order = np.argsort(f)
        return f[order], self.of(hashes)[order]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two feature sets."""
    wa, wb = a[1].sum(), b[1].sum()
    if not wa or not wb or min(wa, wb) < THRESHOLD * max(wa, wb):
        return 0.0 if not wa or not wb else min(wa, wb) / max(wa, wb) * 0.5
    _, at, _ = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = a[1][at].sum()
    return float(both / (wa + wb - both))


class Sampler:
    """Consistent weighted samples; deterministic in the seed."""

    def __init__(self, weights: Weights):
        self.weights = weights
        rng = np.random.default_rng(SEED)
        self.r = rng.gamma(2.0, 1.0, DRAWS)
        self.ln_c = np.log(rng.gamma(2.0, 1.0, DRAWS))
        self.beta = rng.random(DRAWS)
        k = BANDS * ROWS
        self.odds = rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.usual = self._keys(np.arange(DRAWS), np.full(DRAWS, math.log(weights.most)))

    def _keys(self, index: np.ndarray, ln_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln a in 32 bits that sort as it does, above 32 zero bits; and t."""
        t = np.floor(ln_w / self.r[index] + self.beta[index])
        ln_a = (self.ln_c[index] - self.r[index] * (t - self.beta[index] + 1)).astype(np.float32)
        bits = ln_a.view(np.uint32)
        ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        return ordered << np.uint64(32), t.astype(np.int64).astype(np.uint64) * _C

    def bands(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Hashes of each text's bands; None without a word."""
        hashes, sizes = shingles(texts)
        if not len(hashes):
            return [None] * len(texts)
        features = _mix(hashes + occurrences(hashes, sizes).astype(np.uint64) * _C)
        weights = self.weights.of(hashes)
        odd = np.flatnonzero(weights != self.weights.most)
        ln_odd = np.log(weights[odd])
        full = np.flatnonzero(sizes)
        begins = (np.cumsum(sizes) - sizes)[full]
        low = np.uint64(0xFFFFFFFF)
        usual, usual_t = self.usual
        out = np.zeros((BANDS, len(full)), np.uint64)
        for k, o in enumerate(self.odds):
            index = ((features * o) >> np.uint64(48)).astype(np.int64)
            upper, t = usual[index], usual_t[index]
            if len(odd):
                upper[odd], t[odd] = self._keys(index[odd], ln_odd)
            name = (features + t) * _A
            best = np.minimum.reduceat(upper | (name >> np.uint64(32)), begins) & low
            band = k // ROWS
            out[band] = _mix(out[band] * _A + best + np.uint64(band + 1))
        found: list[np.ndarray | None] = [None] * len(texts)
        for j, i in enumerate(full):
            found[i] = out[:, j].astype(np.int64)
        return found


_ODDS = np.random.default_rng(SEED + 1).integers(1, 1 << 63, SKETCHES * SKETCH_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``SKETCHES`` values of each text that has a word, from the smallest hashes of its shingles, unweighted."""
    full = sizes[sizes > 0]
    begins = np.cumsum(full) - full
    out = np.zeros((SKETCHES, len(full)), np.uint64)
    for k, odd in enumerate(_ODDS if len(full) else ()):
        best = np.minimum.reduceat(hashes * odd, begins)
        at = k // SKETCH_ROWS
        out[at] = _mix(out[at] * _A + best + np.uint64(at + 1))
    return out


class Groups:
    """Large groups of near copies: sorted values of sketches, and how many documents have each."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        order = np.argsort(values)
        self.values, self.counts = values[order], counts[order].astype(np.float64)

    def shares(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What each text counts as: 1, or 1 / m in a group of m (the largest one it is in)."""
        out = np.ones(len(sizes))
        if len(self.values) and len(hashes):
            found = sketches(hashes, sizes)
            at = np.minimum(np.searchsorted(self.values, found), len(self.values) - 1)
            out[sizes > 0] = 1 / np.where(self.values[at] == found, self.counts[at], 1).max(axis=0)
        return out


def large_groups(texts: DataFrame) -> tuple[Groups, int]:
    """The large groups among the rows of ``_text``, and the number of rows."""

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = list(batch["_text"])
            for start, stop in text_slices(rows):
                yield pd.DataFrame({"v": sketches(*shingles(rows[start:stop])).ravel().astype(np.int64)})

    documents = texts.count()
    many = F.col("n") >= max(LEAST, math.ceil(LARGE * documents))
    if documents < LEAST:
        return Groups(np.zeros(0, np.uint64), np.zeros(0)), documents
    found = texts.mapInPandas(sketched, "v long").groupBy("v").agg(F.count("*").alias("n")).where(many).toPandas()
    return Groups(found["v"].to_numpy(np.int64).astype(np.uint64), found["n"].to_numpy(np.int64)), documents


def common_shingles(spark: SparkSession, texts: DataFrame) -> Weights:
    """Exact document frequencies of the shingles in at least ``COMMON`` of the rows of ``_text``.

    Documents of a large group of near copies count as one together.
    """
    groups, documents = large_groups(texts)
    shared = ship(spark, groups)

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, counted, total, segment = [], [], 0, 0.0

        def named() -> pd.DataFrame:
            h, at = np.unique(np.concatenate(held), return_inverse=True)
            n = np.bincount(at, np.concatenate(counted))
            h = h[n >= COMMON * segment * (1 - 1e-9)]
            return pd.DataFrame({"h": h.astype(np.int64)})

        for batch in batches:
            rows = list(batch["_text"])
            for start, stop in text_slices(rows):
                hashes, sizes = shingles(rows[start:stop])
                share = opened(shared).shares(hashes, sizes)
                first = occurrences(hashes, sizes) == 0
                held.append(hashes[first])
                counted.append(np.repeat(share, sizes)[first])
                total += len(held[-1])
                segment += share.sum()
                if total >= SEGMENT:
                    yield named()
                    held, counted, total, segment = [], [], 0, 0.0
        if total:
            yield named()

    def share_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = list(batch["_text"])
            total = sum(opened(shared).shares(*shingles(rows[i:j])).sum() for i, j in text_slices(rows))
            yield pd.DataFrame({"n": [float(total)]})

    if len(groups.values):
        documents = texts.mapInPandas(share_of, "n double").agg(F.round(F.sum("n"), 6)).first()[0]
    named = cut(texts.mapInPandas(candidates, "h long").groupBy("h").agg(F.lit(1).alias("_one")))
    many = named.count()
    least = COMMON * documents * (1 - 1e-9)
    hashes, counts = [np.zeros(0, np.int64)], [np.zeros(0)]
    rounds = max(1, math.ceil(many / ROUND))
    for k in range(rounds if many else 0):
        part = named.where(F.pmod(F.xxhash64("h"), F.lit(rounds)) == k).select("h").toPandas()["h"].to_numpy()
        asked = spark.sparkContext.broadcast(np.sort(part.astype(np.uint64)))

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            among = asked.value
            found = np.zeros(len(among))
            for batch in batches:
                rows = list(batch["_text"])
                for start, stop in text_slices(rows):
                    h, sizes = shingles(rows[start:stop])
                    share = np.repeat(opened(shared).shares(h, sizes), sizes)
                    first = occurrences(h, sizes) == 0
                    h, share = h[first], share[first]
                    at = np.minimum(np.searchsorted(among, h), len(among) - 1)
                    hit = among[at] == h
                    found += np.bincount(at[hit], share[hit], len(among))
            at = np.flatnonzero(found)
            yield pd.DataFrame({"h": among[at].astype(np.int64), "n": found[at]})

        common = (
            texts.mapInPandas(count, "h long, n double").groupBy("h").agg(F.round(F.sum("n"), 6).alias("n")).where(F.col("n") >= least)
        ).toPandas()  # rounded, so that the order of a sum does not show
        asked.destroy()
        hashes.append(common["h"].to_numpy(np.int64))
        counts.append(common["n"].to_numpy(float))
    return Weights(np.concatenate(hashes).astype(np.uint64), np.concatenate(counts), documents)


def _verify_pivots(pairs: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """``a, b`` of the pairs ``pivot, doc`` at or above the threshold."""
    left = texts.select(F.col("_id").alias("doc"), F.col("_text").alias("_doc_text"))
    right = texts.select(F.col("_id").alias("pivot"), F.col("_text").alias("_pivot_text"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, seen, features = opened(weights), None, None
        for batch in batches:
            hits = []
            for doc, pivot, x, y in zip(batch["doc"], batch["pivot"], batch["_doc_text"], batch["_pivot_text"]):
                if seen != (pivot, y):  # the rows of a pivot are neighbours
                    seen, features = (pivot, y), w.features(y)
                if similarity(w.features(x), features) >= THRESHOLD:
                    hits.append((doc, pivot))
            yield pd.DataFrame(hits, columns=["a", "b"])

    # Joins of texts are shuffled at every size, so that the plan does not change with it.
    joined = pairs.join(left.hint("merge"), "doc").join(right.hint("merge"), "pivot").sortWithinPartitions("pivot")
    return joined.mapInPandas(check, "a long, b long")


def _verify_blocks(members: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """Links between members ``bucket, doc, comp, m`` of one bucket and different components."""
    cuts = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    blocks = (
        members.withColumn("_cut", F.pmod(F.xxhash64("doc", F.lit(SEED)), cuts).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), cuts - 1)))
        .select("bucket", "doc", "comp", "_cut", F.least("_cut", "_other").alias("_lo"), F.greatest("_cut", "_other").alias("_hi"))
        .join(texts.select(F.col("_id").alias("doc"), "_text").hint("merge"), "doc")
    )
    key = ["bucket", "_lo", "_hi"]

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = opened(weights)

        def one(part: pd.DataFrame) -> pd.DataFrame:
            ids, comps, cut_of = part["doc"].tolist(), part["comp"].tolist(), part["_cut"].tolist()
            across = part["_lo"].iat[0] != part["_hi"].iat[0]
            sets = [w.features(t) for t in part["_text"]]
            root: dict[int, int] = {c: c for c in comps}

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            hits = []
            for i in range(len(ids)):
                for j in range(i):
                    if across and cut_of[i] == cut_of[j]:
                        continue
                    x, y = find(comps[i]), find(comps[j])
                    if x != y and similarity(sets[i], sets[j]) >= THRESHOLD:
                        root[max(x, y)] = min(x, y)
                        hits.append((ids[i], ids[j]))
            return pd.DataFrame(hits, columns=["a", "b"])

        rest: pd.DataFrame | None = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            keys = batch[key].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
            for start, stop in zip(starts, starts[1:]):
                yield one(batch.iloc[start:stop])
            rest = batch.iloc[starts[-1] :]
        if rest is not None:
            yield one(rest)

    return blocks.repartition(*key).sortWithinPartitions(*key).mapInPandas(check, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, kept`` of every row: the smallest id of its class, and whether it is that."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    usable = rows.where(F.col("_id").isNotNull() & F.col("_text").isNotNull())
    shared = ship(spark, common_shingles(spark, usable.select("_text")))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler(opened(shared))
        for batch in batches:
            texts = list(batch["_text"])
            bands = [b for i, j in text_slices(texts) for b in sampler.bands(texts[i:j])]
            yield pd.DataFrame({"_id": batch["_id"], "_digest": batch["_digest"], "bands": bands})

    signed = cut(
        usable.withColumn("_digest", F.unhex(F.sha2("_text", 256))).mapInPandas(
            sign, "_id long, _digest binary, bands array<long>"
        )
    )
    # Equal texts: one of them stands for all.
    firsts = cut(signed.groupBy("_digest").agg(F.min("_id").alias("first")))
    alike = cut(
        signed.select("_id", "_digest").join(firsts, "_digest").select("_id", "first").where("_id <> first").distinct()
    )
    banded = (
        signed.where("bands is not null")
        .join(firsts.select(F.col("first").alias("_id")).distinct(), "_id", "left_semi")
        .select(F.col("_id").alias("doc"), F.explode("bands").alias("bucket"))
    )
    buckets = (
        banded.groupBy("bucket")
        .agg(
            F.count("*").alias("m"),
            F.min("doc").alias("pivot"),
            F.max("doc").alias("_last"),
            F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("_members"),
        )
        .where("pivot <> _last")
        # Bands that hold the same documents are compared once.
        .groupBy("m", "pivot", "_last", "_members")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket", "m", "pivot")
    )
    members = cut(banded.join(buckets, "bucket").select("bucket", "doc", "pivot", "m").distinct())
    texts = cut(usable.join(members.select(F.col("doc").alias("_id")).distinct().hint("merge"), "_id", "left_semi"))
    pairs = members.where("doc <> pivot").select("doc", "pivot").distinct()
    links = cut(_verify_pivots(pairs, texts, shared))
    named = connected_components(links)
    placed = cut(
        members.join(named.select(F.col("v").alias("doc"), "component"), "doc", "left").select(
            "bucket", "doc", "m", F.coalesce("component", "doc").alias("comp")
        )
    )
    several = placed.groupBy("bucket").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y")).where("_x <> _y")
    more = cut(_verify_blocks(placed.join(several.select("bucket"), "bucket"), texts, shared))
    edges = (
        links.unionByName(more).unionByName(alike.select(F.col("_id").alias("a"), F.col("first").alias("b")))
    )
    classes = connected_components(edges)
    return (
        rows.select(F.col("_id").alias("doc_id"))
        .join(classes.select(F.col("v").alias("doc_id"), "component"), "doc_id", "left")
        .select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are: one document of each class."""
    gone = cut(near_duplicates(docs, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct())
    left = docs.join(gone, docs[id_col] == F.col("_gone"), "left_anti")
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").limit(1)
    if repeated.count():
        nulls = left.where(F.col(id_col).isNull())
        left = left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(nulls)
    return left
