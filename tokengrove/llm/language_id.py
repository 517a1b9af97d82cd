"""Language identification by multilingual mixture inference.

A language is a distribution over hashed byte trigrams of lower-cased words, word borders
included. A document is a mixture: each of its words comes from one of the languages, with
unknown proportions. Expectation maximisation estimates the proportions from the words'
trigram likelihoods. Starting with every learned language, the one of the smallest share is
left out as long as that lowers the penalised likelihood's cost (Schwarz: log(words) / 2 for
each language), so the set of languages is chosen and not only ranked. The prediction is the
language with the largest share; ``score`` is that share and ``languages`` the chosen set.

The languages are learned from a sample whose expected size is ``PER_LANGUAGE`` documents of
each, taken by a hash of the text; the sample's counts are made on the executors. At
most ``MOST_LANGUAGES`` values are accepted, which bounds the model at 64 KiB of floats times
four for each.

Defined cases: null, or a text without a letter, is ``und`` with score 0, as is every text when
nothing was learned. Ties go to the first language by code point. Repeated rows get equal
results; language, source and id of a row are never read for its prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tokengrove.llm.base import held_out, opened, ship, text_slices, unit_hash

BUCKETS = 1 << 16
PER_LANGUAGE = 2000
MOST_LANGUAGES = 1000
SMOOTHING = 0.5
ROUNDS, REFITS = 6, 3

_LETTER = re.compile(r"[^\W\d_]")
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each trigram, where each word begins among them, and the text of each word."""
    raw = [b" " + t.lower().encode("utf-8", "replace") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    inside = _IS_LETTER[data]
    shown = np.where(inside, data, 0x20).astype(np.uint32)
    at = np.flatnonzero(inside)
    codes = shown[at - 1] << 16 | shown[at] << 8 | shown[at + 1]
    buckets = (codes * np.uint32(0x9E3779B1)) >> np.uint32(16)
    first = ~inside[at - 1]
    ends = np.cumsum([len(r) for r in raw])
    return buckets, np.flatnonzero(first), np.searchsorted(ends, at[first], side="right")


@dataclass
class LanguageModel:
    languages: list[str]
    logs: np.ndarray  # float32, languages x BUCKETS

    def mixtures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the languages in each text, and which were kept; no words: all zero."""
        n, width = len(texts), len(self.languages)
        shares = np.zeros((n, width))
        active = np.zeros((n, width), bool)
        buckets, starts, of = trigrams(texts)
        if not len(starts) or not width:
            return shares, active
        likely = np.stack([np.add.reduceat(column[buckets], starts) for column in self.logs])
        likely = np.exp(likely - likely.max(axis=0))
        held, begins = np.unique(of, return_index=True)  # the words of a text are neighbours
        words = np.diff(np.append(begins, len(of)))
        row = np.repeat(np.arange(len(held)), words)

        def fit(pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            for k in range(rounds + 1):
                joint = likely * pi[:, row]
                total = joint.sum(axis=0) + np.float32(1e-30)
                if k == rounds:
                    return pi, np.add.reduceat(np.log(total), begins, dtype=np.float64)
                joint /= total
                pi = (np.add.reduceat(joint, begins, axis=1) / words).astype(np.float32)

        every = np.arange(len(held))
        pi, evidence = fit(np.full((width, len(held)), 1.0 / width, np.float32), ROUNDS)
        chosen = np.ones((width, len(held)), bool)
        price = np.log(words + 1.0) / 2
        going = np.ones(len(held), bool)
        for _ in range(width - 1):
            weakest = np.where(chosen, pi, np.inf).argmin(axis=0)
            fewer = chosen.copy()
            fewer[weakest, every] = False
            start = np.where(fewer, np.maximum(pi, np.float32(1e-6)), np.float32(0))
            start /= start.sum(axis=0)
            pi_fewer, evidence_fewer = fit(start, REFITS)
            going &= evidence_fewer + price >= evidence
            pi[:, going], chosen[:, going] = pi_fewer[:, going], fewer[:, going]
            evidence[going] = evidence_fewer[going]
            if not going.any():
                break
        shares[held], active[held] = pi.T, chosen.T
        return shares, active

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[str]]]:
        names, scores, sets = [], [], []
        for start, stop in text_slices(texts):
            part = [t if t is not None and _LETTER.search(t) else "" for t in texts[start:stop]]
            shares, active = self.mixtures(part)
            for i, text in enumerate(part):
                if not text or not shares[i].any():
                    names.append("und")
                    scores.append(0.0)
                    sets.append([])
                else:
                    k = int(shares[i].argmax())
                    names.append(self.languages[k])
                    scores.append(float(min(1.0, shares[i, k])))
                    sets.append([x for x, kept in zip(self.languages, active[i]) if kept])
        return names, scores, sets


def train(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", per_language: int = PER_LANGUAGE
) -> LanguageModel:
    """Learn from rows that have a language and a text; held-out rows must be left out before."""
    rows = docs.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).where(
        F.col("_lang").isNotNull() & F.col("_text").isNotNull()
    )
    sizes = {
        r["_lang"]: r["n"]
        for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    }
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: is {lang_col} the language?")
    if not sizes:
        return LanguageModel([], np.zeros((0, BUCKETS), np.float32))
    share = F.lit(1.0)
    for lang, n in sizes.items():
        if n > per_language:
            share = F.when(F.col("_lang") == lang, F.lit(per_language / n)).otherwise(share)
    sample = rows.where(unit_hash("_text", seed=11) < share)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("_lang"):
                texts = list(part["_text"])
                for start, stop in text_slices(texts):
                    found = np.bincount(trigrams(texts[start:stop])[0], minlength=BUCKETS)
                    at = np.flatnonzero(found)
                    yield pd.DataFrame({"_lang": lang, "_bucket": at, "_n": found[at]})

    counted = (
        sample.mapInPandas(count, "_lang string, _bucket long, _n long")
        .groupBy("_lang", "_bucket")
        .agg(F.sum("_n").alias("_n"))
    )
    languages = sorted(sizes)
    place = {lang: i for i, lang in enumerate(languages)}
    totals = np.zeros((len(languages), BUCKETS))
    # At most BUCKETS rows for each of the languages.
    for r in counted.toLocalIterator():
        totals[place[r["_lang"]], r["_bucket"]] = r["_n"]
    logs = np.log((totals + SMOOTHING) / (totals.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS))
    return LanguageModel(languages, logs.astype(np.float32))


def predicted(spark: SparkSession, text: Column, model: LanguageModel) -> Column:
    """Struct ``lang_pred, score, languages``."""
    shared = ship(spark, model)

    @F.pandas_udf("lang_pred string, score double, languages array<string>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores, sets = opened(shared).predict(list(texts))
            yield pd.DataFrame({"lang_pred": names, "score": scores, "languages": sets})

    return predict(text)


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages`` of every document."""
    model = train(docs.where(~held_out(id_col)), lang_col, text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        held_out(id_col).alias("held_out"),
        predicted(docs.sparkSession, F.col(text_col), model).alias("_p"),
    ).select("doc_id", "held_out", "_p.*")
