"""Byte-pair encoding and decoding by walking a trie of distinct words.

A batch is split into words by the tokenizer's pattern; its distinct words are sorted, which
lays their trie out depth first: the next word shares a path with the last one, and only the
nodes below the shared prefix are new. A node's state is the last token of the encoding of
its prefix, found once, when a word at or below the node first needs it. It is the one token that ends the prefix and may stand behind the state of the
node where it begins, so states follow from states further up, shared prefixes are encoded
once, and a word's tokens are read backwards from its node. Whether two tokens may stand side
by side is decided from the ranks alone: undoing merges at the border, the younger piece
first, no pair across it may have been due before the pieces were merged away.

The result is that of the tokenizers library for byte-level vocabularies without normaliser:
special tokens in a text are recognised, nothing is added. A vocabulary is read on the
driver and broadcast; its size is checked.

Defined cases: a null text is empty and has no tokens. Decoding invalid UTF-8 puts U+FFFD as
the library does. Repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tokengrove.llm.base import opened, ship, text_slices

#: Fixed value: the published pattern of byte-level pre-tokenization.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_FILE_BYTES = 64 << 20
#: What a Python worker remembers: encoded words, and pairs of tokens.
CACHED_WORDS, CACHED_PAIRS = 800_000, 800_000
LONGEST_CACHED = 64
#: Words with more new nodes are walked node by node instead of on demand.
DEEP = 200


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, reversed.

    Bytes that Latin-1 prints stand for themselves, the others are counted up from U+0100.
    """
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printed)]
    return {chr(b): b for b in printed} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class BpeModel:
    """Ranks and tokens of a byte-level vocabulary, and what this process has encoded so far."""

    def __init__(self, definition: dict):
        model = definition["model"]
        pre = definition.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or definition.get("normalizer") or pre.get("type") != "ByteLevel":
            raise ValueError("only byte-level BPE without normaliser is supported")
        if pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only the usual byte-level splitting is supported")
        letters = byte_letters()
        plain = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        self.ids = {plain[t]: i for t, i in model["vocab"].items()}
        self.tokens = {i: b for b, i in self.ids.items()}
        self.specials = {}
        for added in definition.get("added_tokens", ()):
            if added["lstrip"] or added["rstrip"] or added["single_word"]:
                raise ValueError("special tokens that take their surroundings are not supported")
            self.specials[added["content"]] = added["id"]
            self.tokens[added["id"]] = added["content"].encode()
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right
        self.ranks: dict[tuple[int, int], int] = {}
        made = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = model["vocab"][left], model["vocab"][right]
            self.ranks.setdefault((a, b), rank)
            made.append((model["vocab"][left + right], a, b))
        # A token that merging its own bytes does not lead to never comes out of an encoding; of
        # several merges to one token the one that its bytes really take counts.
        reachable = {i for b, i in self.ids.items() if len(b) == 1}
        for rank, (token, a, b) in enumerate(made):
            if token not in reachable and a in reachable and b in reachable and self._stable(a, b, rank):
                self.parts[token] = (rank, a, b)
                reachable.add(token)
        self.by_bytes = {b: i for b, i in self.ids.items() if i in reachable}
        self.longest = max(map(len, self.by_bytes), default=1)
        self._open()

    def _open(self) -> None:
        self.pattern = regex.compile(PATTERN)
        contents = sorted(self.specials, key=lambda s: (-len(s), s))
        self.special = regex.compile("|".join(map(regex.escape, contents))) if contents else None
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.table = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]

    def __getstate__(self):
        drop = ("pattern", "special", "words", "runs", "pairs", "table")
        return {k: v for k, v in self.__dict__.items() if k not in drop}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._open()

    def stable(self, left: int, right: int) -> bool:
        """Do the two tokens stay as they are side by side?"""
        known = self.pairs[left, right] = self._stable(left, right)
        return known

    def _stable(self, left: int, right: int, due: float = float("inf")) -> bool:
        # ``due`` is the time from which a merge across the border comes too late. Of equal
        # ranks the one further left is merged first.
        border_wins_ties = False
        while True:
            rank = self.ranks.get((left, right))
            if rank is not None and (rank < due or rank == due and border_wins_ties):
                return False
            made_left = self.parts.get(left, (-1, 0, 0))
            made_right = self.parts.get(right, (-1, 0, 0))
            if made_left[0] < 0 and made_right[0] < 0:
                return True
            if made_left[0] > made_right[0]:
                due, border_wins_ties, left = made_left[0], False, made_left[2]
            elif made_right[0] > made_left[0]:
                due, border_wins_ties, right = made_right[0], True, made_right[1]
            else:  # the same token twice: the left one is merged first, so undo the right one
                due, border_wins_ties, right = made_right[0], True, made_right[1]

    def encode_distinct(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Walk the trie of ``words`` depth first; yields each distinct word with its tokens."""
        token_of, pair_of, longest = self.by_bytes.get, self.pairs.get, self.longest
        last: list[int] = [-1]  # the state of each prefix of the current word; -1: not asked for yet
        size: list[int] = [0]
        before = word = b""

        def state(end: int) -> int:
            begin = end - longest if end > longest else 0
            while begin < end:
                token = token_of(word[begin:end])
                if token is not None:
                    if begin:
                        left = last[begin]
                        if left < 0:
                            left = state(begin)
                        stays = pair_of((left, token))
                        if stays is None:
                            stays = self.stable(left, token)
                    if not begin or stays:
                        last[end] = token
                        size[end] = end - begin
                        return token
                begin += 1
            raise ValueError("the vocabulary lacks a byte")

        for word in sorted(set(words)):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            new = len(word) - shared
            del last[shared + 1 :], size[shared + 1 :]
            last += [-1] * new
            size += [0] * new
            if new > DEEP:  # from the top, so that no state waits for many others
                for end in range(1, len(word)):
                    if last[end] < 0:
                        state(end)
            before = word
            tokens, end = [], len(word)
            while end:
                tokens.append(last[end] if last[end] >= 0 else state(end))
                end -= size[end]
            yield word, tokens[::-1]

    def _learn(self, words: set[str]) -> None:
        as_bytes = {w.encode("utf-8", "replace"): w for w in words}
        for raw, tokens in self.encode_distinct(list(as_bytes)):
            self.words[as_bytes[raw]] = pack("<%dI" % len(tokens), *tokens)

    def _encode_words(self, lists: list[list[str]]) -> list[bytes]:
        """Packed ids of each list of words; words not seen before go through the trie together."""
        new = set().union(*lists).difference(self.words)
        self._learn(new)
        packed = [b"".join(map(self.words.__getitem__, words)) for words in lists]
        for w in new:
            if len(w) > LONGEST_CACHED:
                del self.words[w]
        return packed

    def _encode_whole(self, text: str) -> bytes:
        """A text with special tokens or white space that the splitting at single spaces can't take."""
        if self.special is None:
            return self._encode_words([self.pattern.findall(text)])[0]
        parts, start = [], 0
        for m in self.special.finditer(text):
            parts.append((self.pattern.findall(text[start : m.start()]), m.group()))
            start = m.end()
        parts.append((self.pattern.findall(text[start:]), None))
        packed = self._encode_words([words for words, _ in parts])
        return b"".join(
            ids + (b"" if special is None else np.array([self.specials[special]], "<u4").tobytes())
            for ids, (_, special) in zip(packed, parts)
        )

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        A text is cut at its spaces first: a run between two single spaces that neither begins
        nor ends in white space is split the same in any surroundings, so the ids of
        runs seen before are only looked up. Texts with other runs are split as a whole.
        """
        if len(self.runs) + len(self.words) > CACHED_WORDS:
            self.runs.clear()
            self.words.clear()
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs.clear()
        whole = [t or "" for t in texts]
        cut = [
            None if not t or self.special is not None and self.special.search(t) else t.split(" ")
            for t in whole
        ]
        new = set().union(*[runs[1:] for runs in cut if runs]).difference(self.runs)
        plain = [r for r in new if r and not r[0].isspace() and not r[-1].isspace()]
        self.runs.update(dict.fromkeys(new))  # those that stay None are not plain
        self.runs.update(zip(plain, self._encode_words([self.pattern.findall(" " + r) for r in plain])))
        out = []
        for text, runs in zip(whole, cut):
            if not text:
                out.append(b"")
                continue
            ids = None
            if runs and runs[0] and not runs[0][0].isspace() and not runs[0][-1].isspace():
                found = list(map(self.runs.__getitem__, runs[1:]))
                if None not in found:
                    ids = self._encode_words([self.pattern.findall(runs[0])])[0] + b"".join(found)
            out.append(self._encode_whole(text) if ids is None else ids)
        for r in new:
            if len(r) > LONGEST_CACHED:
                del self.runs[r]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of packed ids."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.table.__getitem__, numbers)).decode("utf-8", "replace")


def read_model(path: str) -> BpeModel:
    with open(path, "rb") as f:
        raw = f.read(MOST_FILE_BYTES + 1)
    if len(raw) > MOST_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MOST_FILE_BYTES} bytes")
    return BpeModel(json.loads(raw))


def encode_column(spark: SparkSession, text: Column, model: BpeModel) -> Column:
    """A text's ids as ``array<int>``."""
    shared = ship(spark, model)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = list(texts)
            packed = [x for a, b in text_slices(texts, 4 << 20) for x in opened(shared).encode_batch(texts[a:b])]
            yield pd.Series([np.frombuffer(x, "<i4") for x in packed], dtype=object)

    return encode(text)


def decode_column(spark: SparkSession, ids: Column, model: BpeModel) -> Column:
    """The text of ``array<int>`` ids; null ids give null."""
    shared = ship(spark, model)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(
                [None if r is None else opened(shared).decode(np.asarray(r, "<u4").tobytes()) for r in rows], dtype=object
            )

    return decode(ids)


def digest_encoding(
    docs: DataFrame, model: BpeModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document, encoded and decoded again."""
    shared = ship(docs.sparkSession, model)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            model, out = opened(shared), []
            texts = list(texts)
            for start, stop in text_slices(texts, 4 << 20):
                for ids in model.encode_batch(texts[start:stop]):
                    decoded = model.decode(ids).encode("utf-8")
                    out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("_d")).select("doc_id", "_d.*")
