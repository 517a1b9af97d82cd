"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A window of
text that shares more with toxic text compresses to fewer bytes with the toxic dictionary.
A window is a word in a frame which both dictionaries hold: the frame lets zstandard
compress blocks this short, so the difference of the two lengths comes from the word alone.
(Windows of several words were tried first: chance matches of harmless words then outweigh
the few bytes that an insult saves, AUC 0.6 to 0.8.) A word too short to save bytes is
lengthened by a digest of itself. The ordinary dictionary holds all words of the ordinary sample
that the toxic one lacks; the toxic one those that are toxic by more than chance, as words or by a
byte 6-gram: ``RATIO`` times as often in toxic as in ordinary documents, and within the false
discoveries that ``CHANCE`` allows. There is no least share of the documents, so insults of rare
languages or many rare insults count; in copies only what differs is evidence. Shares of windows that differ by at
least 3, 4, 5 and 6 bytes then give a calibrated probability; predicted is score >= 0.5.

Defined cases: null counts as empty; a text without windows gets the probability of no
difference. Without labelled rows of both classes the score is 0 everywhere. Repeated rows
get equal scores; only the text is read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tokengrove.llm.base import held_out, labelled_sample, opened, ship
from tokengrove.llm.logistic import fit_dense, sigmoid

#: Labelled rows of each class that are used to fit.
PER_CLASS = 2500
GRAM, RATIO, CHANCE = 6, 8.0, 0.1
LEVEL = 3
STEPS = (3, 4, 5, 6)
#: Words whose difference a Python worker remembers.
CACHED_WORDS = 400_000

_FRAME = b"\n0123456789abcdef\n"
_WINDOW = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def windows(text: str | None) -> list[bytes]:
    return _WINDOW.findall((text or "").lower().encode("utf-8", "replace"))


def _grams(word: bytes) -> set[bytes]:
    framed = b" " + word + b" "
    return {framed[i : i + GRAM] for i in range(len(framed) - GRAM + 1)}


def _document_counts(docs: list[set[bytes]]) -> Counter:
    found: Counter = Counter()
    for words in docs:
        grams: set[bytes] = set()
        for w in words:
            grams |= _grams(w)
        found.update(grams)
    return found


def _word_counts(docs: list[set[bytes]]) -> Counter:
    return Counter(w for words in docs for w in words)


def _first_seen(docs: list[list[bytes]]) -> list[set[bytes]]:
    """Of each document the words between neighbours of no earlier document: copies are no evidence."""
    seen: set[int] = set()
    out = []
    for words in docs:
        here = {hash(t): t[1] for t in zip([b"", *words], words, [*words[1:], b""])}
        out.append({w for k, w in here.items() if k not in seen})
        seen.update(here)
    return out


def _telling(often: Counter, other: Counter, toxic: int, ordinary: int) -> set[bytes]:
    """Units that are toxic by more than chance, of any frequency.

    ``RATIO`` times as often in toxic documents, and by Benjamini and Hochberg's rule at ``CHANCE``:
    how few documents are enough depends on how many units of such a count there are.
    """
    share = often.total() / max(1, often.total() + other.total())
    tested = sum(n + other[g] > 1 for g, n in often.items()) + sum(n > 1 for g, n in other.items() if g not in often)
    known: dict[tuple[int, int], float] = {}
    found = []
    for g, n in often.items():
        m = other[g]
        if n < 2 or (n + 0.5) / toxic <= RATIO * (m + 0.5) / (ordinary + 1):
            continue
        if (n, m) not in known:
            known[n, m] = sum(
                math.exp(
                    math.lgamma(n + m + 1) - math.lgamma(k + 1) - math.lgamma(n + m - k + 1)
                    + (n + m - k) * math.log(share) + k * math.log1p(-share)
                )
                for k in range(m + 1)
            ) if share < 1 else 1.0
        found.append((known[n, m], g))
    found.sort()
    enough = max((p for k, (p, _) in enumerate(found, 1) if p * tested <= CHANCE * k), default=-1.0)
    return {g for p, g in found if p <= enough}


def _framed(word: bytes) -> bytes:
    """The word as windows and dictionaries hold it; a digest lengthens one too short to save bytes."""
    if len(word) < GRAM:
        return b" %s%04x " % (word, crc32(word) & 0xFFFF)
    return b" " + word + b" "


def _dictionary(counts: Counter) -> bytes:
    """All words, the most frequent last: there zstandard finds them best."""
    return b"".join(_framed(w) for w, _ in sorted(counts.items(), key=lambda item: (item[1], item[0])))


class ToxicityModel:
    """Two dictionaries and the calibration; what it remembers of words stays in its process."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.dictionaries = (toxic, ordinary)
        self.beta = np.zeros(len(STEPS) + 1)
        self._open()

    def _open(self) -> None:
        self.known: dict[bytes, int] = {}
        self.cached_bytes = 0
        self.compressors = []
        for content in self.dictionaries:
            d = zstandard.ZstdCompressionDict(content + _FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(
                    dict_data=d, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False
                )
            )

    def __getstate__(self):
        return self.dictionaries, self.beta

    def __setstate__(self, state):
        self.dictionaries, self.beta = state
        self._open()

    def difference(self, word: bytes) -> int:
        """Bytes that the toxic dictionary saves over the ordinary one."""
        window = _FRAME + _framed(word) + _FRAME
        toxic, ordinary = (len(c.compress(window)) for c in self.compressors)
        return ordinary - toxic

    def shares(self, words: list[bytes]) -> list[float]:
        known = self.known
        if len(known) > CACHED_WORDS or self.cached_bytes > 64 * CACHED_WORDS:
            known.clear()
            self.cached_bytes = 0
        for w in set(words).difference(known):
            known[w] = self.difference(w)
            self.cached_bytes += len(w)
        saved = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return [float(np.log1p(1000.0 * (saved >= step).sum() / (len(words) + 5))) for step in STEPS]

    def scores(self, texts) -> np.ndarray:
        x = np.array([self.shares(windows(t)) for t in texts], float).reshape(-1, len(STEPS))
        return sigmoid(x @ self.beta[:-1] + self.beta[-1])


def fit(sample: list[tuple[str, int]], counts: dict[int, int]) -> ToxicityModel | None:
    """Three quarters of a bounded sample train the dictionaries, the rest calibrates."""
    words = [windows(t) for t, _ in sample]
    y = np.array([label for _, label in sample], float)
    if len(set(y)) < 2:
        return None
    later = np.zeros(len(y), bool)
    for label in (0, 1):
        later[np.flatnonzero(y == label)[3::4]] = True
    toxic = [w for w, t, k in zip(words, y, later) if t == 1 and not k]
    ordinary = [w for w, t, k in zip(words, y, later) if t == 0 and not k]
    first = [_first_seen(docs) for docs in (toxic, ordinary)]
    sizes = len(toxic), len(ordinary)
    whole, stems = (_telling(count(first[0]), count(first[1]), *sizes) for count in (_word_counts, _document_counts))
    marked = Counter(w for doc in toxic for w in set(doc) if w in whole or not stems.isdisjoint(_grams(w)))
    harmless = Counter(w for doc in ordinary for w in set(doc))
    for w in marked:
        harmless.pop(w, None)
    model = ToxicityModel(_dictionary(marked), _dictionary(harmless))
    use = later if len(set(y[later])) == 2 else ~later
    x = np.array([model.shares(w) for w, k in zip(words, use) if k])
    truth = y[use]
    weight = np.where(
        truth == 1,
        counts.get(1, 1) / max(1, (truth == 1).sum()),
        counts.get(0, 1) / max(1, (truth == 0).sum()),
    )
    model.beta = fit_dense(x, truth, weight, 1e-3)
    model._open()
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, **names: str) -> ToxicityModel | None:
    return fit(*labelled_sample(docs, labels, "toxic", per_class, **names))


def toxic_score(spark: SparkSession, text: Column, model: ToxicityModel | None) -> Column:
    if model is None:
        return F.lit(0.0)
    shared = ship(spark, model)  # two dictionaries: the distinct words of a bounded sample

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(opened(shared).scores(texts))

    return score(text)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    scored = docs.select(
        F.col(id_col).alias("doc_id"), toxic_score(docs.sparkSession, F.col(text_col), model).alias("score")
    )
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is not predicted toxic."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    return docs.where(toxic_score(docs.sparkSession, F.col(text_col), model) < 0.5)
