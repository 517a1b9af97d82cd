"""Token counts: a byte-based stand-in and byte-pair encodings."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
import base64
import heapq
import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import LongType


def tokens_bytes4(size: Column) -> Column:
    """One token per four bytes, rounded up: an integer estimate needing no vocabulary."""
    return F.shiftright(size.cast("bigint") + 3, 2)


# Published pre-tokenisation patterns of the encodings (fixed values). ``(?U)`` gives
# ``\s`` its Unicode meaning in the JVM.
_GPT2_PATTERN = (
    r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
)
_CL100K_PATTERN = (
    r"(?U)'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+"
    r"| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"
)
_UPPER = r"\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}"
_LOWER = r"\p{Ll}\p{Lm}\p{Lo}\p{M}"
_O200K_PATTERN = (
    rf"(?U)[^\r\n\p{{L}}\p{{N}}]?[{_UPPER}]*[{_LOWER}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
    rf"|[^\r\n\p{{L}}\p{{N}}]?[{_UPPER}]+[{_LOWER}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
    r"|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+"
)
_FIM = ("<|fim_prefix|>", "<|fim_middle|>", "<|fim_suffix|>")

# name -> (pattern, special tokens, models described) (fixed values)
ENCODINGS: dict[str, tuple[str, tuple[str, ...], str]] = {
    "o200k_base": (
        _O200K_PATTERN,
        ("<|endoftext|>", "<|endofprompt|>"),
        "GPT-4o models, o1 models",
    ),
    "cl100k": (
        _CL100K_PATTERN,
        ("<|endoftext|>", *_FIM, "<|endofprompt|>"),
        "ChatGPT models, text-embedding-ada-002",
    ),
    "p50k_base": (
        _GPT2_PATTERN,
        ("<|endoftext|>",),
        "Code models, text-davinci-002, text-davinci-003",
    ),
    "p50k_edit": (
        _GPT2_PATTERN,
        ("<|endoftext|>", *_FIM),
        "Edit models like text-davinci-edit-001, code-davinci-edit-001",
    ),
    "r50k_base": (_GPT2_PATTERN, ("<|endoftext|>",), "GPT-3 models like davinci"),
}
ALIASES = {"gpt2": "r50k_base", "cl100k_base": "cl100k"}
DEFAULT_ENCODING = "cl100k"
MAX_VOCABULARY = 1_000_000  # what executors each hold a copy of
REMEMBERED = 250_000  # merged pieces that a Python worker keeps
AT_ONCE = 1 << 18  # pieces that are looked up at a time: arrays over a whole batch are many times its text


@dataclass(frozen=True)
class Tokenizer:
    """A byte-pair encoding: how text is split, and the rank of each mergeable byte string."""

    name: str
    pattern: str
    ranks: Mapping[bytes, int] = field(repr=False)
    specials: tuple[str, ...] = ()


def register_tokenizer(
    name: str,
    ranks_path: str | None = None,
    *,
    ranks: Mapping[bytes, int] | None = None,
    pattern: str | None = None,
    specials: tuple[str, ...] | None = None,
) -> Tokenizer:
    """A tokenizer from a published encoding name or one's own pattern.

    ``ranks_path`` is a vocabulary file of ``base64 rank`` lines. Published
    vocabularies have about 50k to 200k entries; the size is checked.
    """
    name = ALIASES.get(name, name)
    known = ENCODINGS.get(name)
    if pattern is None:
        if known is None:
            raise ValueError(f"unknown encoding {name!r} needs a pattern")
        pattern = known[0]
    if specials is None:
        specials = known[1] if known else ()
    if ranks is None:
        if ranks_path is None:
            raise ValueError("give ranks or ranks_path")
        with open(ranks_path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            ranks = {base64.b64decode(tok): int(rank) for tok, rank in pairs}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} entries are too many to send to every executor")
    if not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    return Tokenizer(name, pattern, dict(ranks), tuple(specials))


def merged_length(piece: bytes, ranks: Mapping[bytes, int]) -> int:
    """How many tokens ``piece`` merges into: lowest rank first, leftmost on ties.

    Candidate pairs wait in a heap over a linked list, so even a piece of a megabyte
    takes n log n steps.
    """
    if piece in ranks:
        return 1
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: where the token starting at i ends; 0 once absorbed
    before = list(range(-1, n - 1))
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    count = n
    while heap:
        _, left, stop = heapq.heappop(heap)
        mid = end[left]
        if not mid or mid >= n or end[mid] != stop:
            continue
        end[left], end[mid] = stop, 0
        count -= 1
        if stop < n:
            before[stop] = left
            rank = ranks.get(piece[left : end[stop]])
            if rank is not None:
                heapq.heappush(heap, (rank, left, end[stop]))
        prev = before[left]
        if prev >= 0:
            rank = ranks.get(piece[prev:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, prev, stop))
    return count


def pretokens(text: Column, tokenizer: Tokenizer) -> Column:
    """The pieces of ``text`` that are merged on their own, in order; special tokens are pieces."""

    def split(part: Column) -> Column:
        return F.regexp_extract_all(part, F.lit(tokenizer.pattern), F.lit(0))

    if not tokenizer.specials:
        return split(text)
    specials = "|".join(_quote(s) for s in sorted(tokenizer.specials, key=len, reverse=True))
    # What touches a special token must not swallow it.
    apart = F.split(text, f"(?={specials})|(?<={specials})", -1)
    each = F.transform(apart, lambda p: F.when(p.isin(*tokenizer.specials), F.array(p)).otherwise(split(p)))
    shared = os.path.commonprefix(list(tokenizer.specials))
    may_have = text.contains(shared)  # a plain search spares almost all texts the rest
    return F.when(may_have, F.flatten(each)).otherwise(split(text))


def merged_tokens(spark: SparkSession, pieces: Column, tokenizer: Tokenizer) -> Column:
    """How many tokens the pieces of :func:`pretokens` merge into; null gives null.

    A task merges each distinct piece of a batch once and remembers it. Nothing is
    shuffled, so neither a frequent word nor a large repository is hot.
    """
    shipped = spark.sparkContext.broadcast(dict(tokenizer.ranks))
    vocabulary, specials = uuid.uuid4().hex, frozenset(tokenizer.specials)

    @F.arrow_udf(LongType())
    def count(pieces: pa.Array) -> pa.Array:
        ranks = shipped.value
        memo = _memo(vocabulary)

        def length(piece: str) -> int:
            known = memo.get(piece)
            if known is None:
                known = 1 if piece in specials else merged_length(piece.encode(), ranks)
                if len(piece) <= 64 and len(memo) < REMEMBERED:
                    memo[piece] = known
            return known

        return row_sums(pieces, length)

    return count(pieces)


def row_sums(lists: pa.Array, value: Callable[[str], int]) -> pa.Array:
    """For each list of strings the sum of their values, null for null; ``AT_ONCE`` strings are looked at at a time."""
    strings, ends = lists.values, lists.offsets.to_numpy().astype(np.int64)
    sums = np.zeros(len(lists), np.int64)
    for start in range(int(ends[0]), int(ends[-1]), AT_ONCE):
        stop = min(start + AT_ONCE, int(ends[-1]))
        coded = strings.slice(start, stop - start).dictionary_encode()
        known = np.fromiter((value(s.as_py()) for s in coded.dictionary), np.int64, len(coded.dictionary))
        upto = np.concatenate([[0], np.cumsum(known[coded.indices.to_numpy()])])
        first, last = np.searchsorted(ends, start, side="right") - 1, np.searchsorted(ends, stop)
        at = np.clip(ends[first : last + 1], start, stop) - start
        sums[first:last] += upto[at[1:]] - upto[at[:-1]]
        del coded, known, upto
    return pa.array(sums, mask=~lists.is_valid().to_numpy(False))


def bpe_tokens(spark: SparkSession, text: Column, tokenizer: Tokenizer) -> Column:
    """Token count of ``text``; each special token counts as one, null text gives null.

    The JVM splits the text, see :func:`merged_tokens` for the rest.
    """
    return merged_tokens(spark, pretokens(text, tokenizer), tokenizer)


_MEMOS: dict[str, dict[str, int]] = {}


def _memo(vocabulary: str) -> dict[str, int]:
    """The worker process's merged lengths for the vocabulary last used; bounded by its caller."""
    if vocabulary not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[vocabulary] = {}
    return _MEMOS[vocabulary]


def _quote(literal: str) -> str:
    return re.sub(r"([\\.+*?()|\[\]{}^$])", r"\\\1", literal)
