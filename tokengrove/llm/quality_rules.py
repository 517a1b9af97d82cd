"""Quality rules: counted rules first, then logistic regression on hashed n-grams.

The features of a text are the relative frequencies of hashed words, word pairs and
byte 4-grams (a rolling window over the UTF-8 bytes), so a text's logit is the mean of the
weights of its n-grams: one gather and one segmented sum, in Arrow batches, over the whole
text. The weights are fitted on a bounded sample of labelled rows (``per_class`` of each
label), three quarters for the weights and one quarter for calibrating the logit to a
probability. The thresholds are fixed.

Defined cases: a null text has no words and fails the rules, as an empty one does. Without
examples of both labels the model knows nothing and the rules decide alone. Repeated rows
get equal verdicts; no other column is read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tokengrove.llm.base import WORD, labelled_sample, text_slices
from tokengrove.llm.logistic import fit_dense, fit_sparse, sigmoid

#: Buckets per kind of n-gram.
WIDTH = 1 << 14
#: Labelled rows of each class that are used to fit.
PER_CLASS = 2000
#: The fixed thresholds: fewest words, percent of repeated words, least probability of label 1.
LEAST_WORDS, MOST_REPEATED, LEAST_QUALITY = 20, 30, 0.5
#: Words in a window that must not come twice.
WINDOW = 8

_WORDS = re.compile(WORD)
_BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, 0x100000001B3, dtype=np.uint64))


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside a window of words that is found twice or more in the text.

    Windows are compared exactly: each word has a number, and numbers of runs of twice the
    length are found from pairs until the run is a window.
    """
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[str, int] = {}
    runs = np.fromiter(map(numbers.setdefault, words, count()), np.int64, n)
    if len(numbers) == n:
        return 0
    # Equal windows have equal sums: where all sums differ, no window comes twice.
    mixed = (runs.astype(np.uint64) + np.uint64(1)) * _ODD
    mixed ^= mixed >> np.uint64(29)
    sums = np.zeros(n - window + 1, np.uint64)
    for i in range(window):
        sums += mixed[i : n - window + 1 + i] * _POWERS[i]
    sums.sort()
    if not (sums[1:] == sums[:-1]).any():
        return 0
    length = 1
    while length < window:
        step = min(length, window - length)
        pairs = runs[:-step] * (n + 1) + runs[step:]
        runs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        length += step
    often = np.bincount(runs)[runs] >= 2
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(often)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def count_rules(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    text = text or ""
    words = _WORDS.findall(text)
    lines = [line for line in text.split("\n") if line.strip(_BLANK)]
    return (
        len(words),
        sum(map(len, words)),
        len(_SYMBOLS.findall(text)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def hashed(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind of n-gram: bucket of each occurrence, its text, and each text's occurrences."""
    raw = [t.encode("utf-8", "replace") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    doc = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    wide = data.astype(np.uint64)
    out = []

    def add(hashes: np.ndarray, of: np.ndarray, kind: int) -> None:
        buckets = ((hashes * _ODD) >> np.uint64(50)).astype(np.int64) + kind * WIDTH
        out.append((buckets, of, np.bincount(of, minlength=len(raw))))

    inside = ~((data == 0x20) | ((data >= 9) & (data <= 13)))
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if len(starts):
        stops = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
        at = np.arange(len(data))
        first = np.repeat(starts, stops - starts)
        place = (at[inside] - first) & 63
        pieces = (wide[inside] + np.uint64(1)) * _POWERS[place]
        words = np.add.reduceat(pieces, np.concatenate(([0], np.cumsum(stops - starts)[:-1])))
        of = doc[starts]
        add(words, of, 0)
        same = of[1:] == of[:-1]
        add((words[:-1] * np.uint64(31) + words[1:] + np.uint64(7))[same], of[1:][same], 1)
    if len(data) > 4:
        grams = wide[:-3] << np.uint64(24) | wide[1:-2] << np.uint64(16) | wide[2:-1] << np.uint64(8) | wide[3:]
        at = np.arange(len(grams))
        whole = at + 4 < ends[doc[:-3]]
        add(grams[whole] + np.uint64(1 << 40), doc[:-3][whole], 2)
    return out


@dataclass
class QualityModel:
    weights: np.ndarray  # float32, three kinds of n-grams one after the other
    bias: float
    slope: float
    shift: float

    def logits(self, texts: list[str]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        for buckets, of, sizes in hashed(texts):
            sums = np.bincount(of, weights=self.weights[buckets], minlength=len(texts))
            total += sums / np.maximum(sizes, 1)
        return total

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.slope * self.logits(texts) + self.shift)


def fit(sample: list[tuple[str, int]], counts: dict[int, int]) -> QualityModel | None:
    """The model of a bounded sample; ``counts`` of all labels set the prior. None without both labels."""
    y = np.array([label for _, label in sample], float)
    if len(set(y)) < 2:
        return None
    texts = [text for text, _ in sample]
    rows, cols, values = [], [], []
    for start, stop in text_slices(texts):
        for buckets, of, sizes in hashed(texts[start:stop]):
            key, n = np.unique(of.astype(np.int64) * (3 * WIDTH) + buckets, return_counts=True)
            local = key // (3 * WIDTH)
            rows.append((local + start).astype(np.int32))
            cols.append((key % (3 * WIDTH)).astype(np.int32))
            values.append((n / np.maximum(sizes, 1)[local]).astype(np.float32))
    rows, cols, values = map(np.concatenate, (rows, cols, values))
    later = np.arange(len(y)) % 4 == 3  # calibrates
    if len(set(y[later])) < 2 or len(set(y[~later])) < 2:
        later = np.zeros(len(y), bool)
    use = ~later[rows]
    number = np.cumsum(~later) - 1
    w, bias = fit_sparse(number[rows[use]], cols[use], values[use], y[~later], 3 * WIDTH)
    model = QualityModel(w.astype(np.float32), bias, 1.0, 0.0)
    check = later if later.any() else ~later
    logits = np.bincount(rows, weights=values * w[cols], minlength=len(y))[check] + bias
    truth = y[check]
    weight = np.where(
        truth == 1,
        counts.get(1, 1) / max(1, (truth == 1).sum()),
        counts.get(0, 1) / max(1, (truth == 0).sum()),
    )
    model.slope, model.shift = map(float, fit_dense(logits[:, None], truth, weight, 1e-4))
    return model


VERDICT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, quality double, kept boolean"
)


def verdict(text: Column, model: QualityModel | None) -> Column:
    """The struct ``VERDICT`` of a text."""

    @F.pandas_udf(VERDICT)
    def judge(texts: pd.Series) -> pd.DataFrame:
        whole = [t if t is not None else "" for t in texts]
        rules = np.array([count_rules(t) for t in whole], np.int64).reshape(-1, 5)
        failed = (rules[:, 0] < LEAST_WORDS) | (100 * rules[:, 4] > MOST_REPEATED * rules[:, 0])
        quality = np.ones(len(whole))
        if model is not None:
            for start, stop in text_slices(whole):
                quality[start:stop] = model.probabilities(whole[start:stop])
        out = pd.DataFrame(rules, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
        out["base_failed"] = failed
        out["quality"] = quality
        out["kept"] = ~failed & (quality >= LEAST_QUALITY)
        return out

    return judge(text)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, **names: str) -> QualityModel | None:
    return fit(*labelled_sample(docs, labels, "quality", per_class, **names))


def judge_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: its id and the columns of ``VERDICT``."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), verdict(F.col(text_col), model).alias("_v")
    ).select("doc_id", "_v.*")


def keep_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is kept."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    return docs.where(verdict(F.col(text_col), model)["kept"])
