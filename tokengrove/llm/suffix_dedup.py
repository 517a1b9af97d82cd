"""Repeated passages by suffix arrays in two stages.

Texts are packed into slices of about ``SLICE`` bytes, a table bucketed by slice, which later steps
join without moving texts. Every string of ``SPAN`` bytes has an anchor: its ``GRAM`` bytes of smallest
hash. A text is cut into fragments, maximal runs of strings with the same anchor. A string holds
the anchor with ``REACH`` bytes behind it or, if not, before it; slices ask which of these halves
(hashes of them, sorted and packed) occur in another document, and drop strings whose half does not.
What is left is dealt to buckets by the hash of the anchor, so that equal strings meet.

In a bucket the suffixes that are smaller than their successors are sorted directly, to a depth of
``SPAN`` bytes; the others are induced by one scan over the buckets of first bytes, in which a suffix
that has its place puts the suffix one byte longer at the end of that one's bucket. Adjacent
common prefixes of ``SPAN`` bytes or more then join equal strings, and all but those of the smallest id
are removed. A bucket is sorted by itself; the number of buckets follows the bytes of the corpus.

Skew: a slice ships equal fragments once, for its smallest id; those of larger ids are marked
where they are. Halves that very many fragments hold (a common line between different neighbours)
come back as hot; their strings are dealt one by one, by the hash of the whole string.

Cost: the packed texts are written once; halves are about 2.5 bytes for each 10 of text, and fragments
that may repeat 70 bytes for each 20, compressed; both are shuffled once.

Defined cases: a null or empty text has no bytes, nothing is removed from it. A row without an id
neither removes nor loses anything. Rows that repeat an id are documents of equal rank, so none
removes from another; each returns its row. A document does not remove its own repeats.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from tokengrove.plans.lineage import work_dir

#: Bytes of a string that counts as repeated; bytes of an anchor.
SPAN, GRAM = 50, 12
#: A string reaches at least so far from its anchor on one side.
REACH = (SPAN - GRAM) // 2
HALF = REACH + GRAM
#: Text bytes of a slice; fragment bytes of a bucket before unrepeated ones are dropped.
SLICE, BUCKET = 8 << 20, 8 << 20
#: Hashes of halves that one task holds.
HASHES = 2 << 20
#: A half of more fragments than this is hot.
HOT = 50_000
LEVEL = 3

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def words_at(data: bytes) -> np.ndarray:
    """The eight bytes at every position as a big-endian number; ``data`` must end in eight spare bytes."""
    return np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))


def hash_bytes(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the ``n`` bytes (8 or more) at each position."""
    out = np.zeros(len(at), np.uint64)
    for k in (*range(0, n - 8, 8), n - 8):
        out = (out ^ words[at + k].astype(np.uint64)) * _MIX[0]
        out ^= out >> np.uint64(29)
    out *= _MIX[1]
    return out ^ (out >> np.uint64(32))


def anchors(data: bytes) -> np.ndarray:
    """For each string of ``SPAN`` bytes of ``data`` the position of its anchor, the leftmost of equals.

    ``data`` must end in eight spare bytes, which belong to no string.
    """
    words, n = words_at(data), len(data) - 8
    grams = n - GRAM + 1
    if n < SPAN:
        return np.empty(0, np.int64)
    best = words[:grams].astype(np.uint64) * _MIX[0]
    best ^= best >> np.uint64(31)
    best ^= words[GRAM - 8 : GRAM - 8 + grams].astype(np.uint64) * _MIX[1]
    best *= _MIX[2]
    best &= np.uint64((1 << 64) - (1 << 28))
    best |= np.arange(grams, dtype=np.uint64)  # the place breaks ties
    width, reach = SPAN - GRAM + 1, 1
    while 2 * reach <= width:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if reach < width:
        best = np.minimum(best[: len(best) - (width - reach)], best[width - reach :])
    return (best & np.uint64((1 << 28) - 1)).astype(np.int64)


class Fragments:
    """Fragments of some pieces of text, laid end to end: where each starts, its strings, anchor and piece."""

    def __init__(self, texts: list[bytes]):
        self.data = b"".join(texts) + bytes(8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(sizes) - sizes
        of = anchors(self.data)
        # A string must end where its piece does or earlier.
        valid = np.zeros(len(of) + 1, np.int32)
        has = sizes >= SPAN
        np.add.at(valid, self.first[has], 1)
        np.add.at(valid, (self.first + sizes)[has] - SPAN + 1, -1)
        at = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
        of = of[at]
        starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(at) else at
        self.start, self.anchor = at[starts], of[starts]
        self.strings = np.diff(np.append(starts, len(at)))
        self.piece = np.searchsorted(self.first, self.start, "right") - 1

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """Strings that hold the half behind the anchor come first turned round: those from ``split`` on do,
        those before hold the half before it. ``split`` counts strings; ``hash`` is of either half, 0 where no
        string needs it."""
        words = words_at(self.data)
        # A string that starts at p holds the half behind if p + SPAN >= anchor + HALF.
        split = np.clip(self.anchor + HALF - SPAN - self.start, 0, self.strings)
        hashes = np.zeros((2, len(split)), np.uint64)
        for side, needed, at in ((0, split > 0, self.anchor - REACH), (1, split < self.strings, self.anchor)):
            which = np.flatnonzero(needed)
            hashes[side, which] = hash_bytes(words, at[which], HALF) | np.uint64(1)
        return split, hashes


def packed_slices(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_slice, _size, _blob``: documents packed in order of ids, written as a table bucketed by slice."""
    spark = docs.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Rows without an id come last and are told apart by their number.
            ids = [None if i is None else int(i) for i in batch["_id"]]
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            held, size = [], 0
            for k, i in enumerate(order):
                held.append((ids[i], batch["_text"].iat[i].encode()))
                size += len(held[-1][1])
                if size >= SLICE or k == len(order) - 1:
                    sizes = np.array([len(t) for _, t in held], np.int64)
                    own = np.array([i or 0 for i, _ in held], np.int64)
                    blob = pack([own, np.array([i is not None for i, _ in held]), sizes], b"".join([t for _, t in held]))
                    yield pd.DataFrame({"_slice": [batch["_row"].iat[i]], "_size": [size], "_blob": [blob]})
                    held, size = [], 0

    rows = docs.select(
        F.col(id_col).cast("long").cast("string").alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.monotonically_increasing_id().alias("_row"),
    )
    name, buckets = f"slices_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.mapInPandas(run, "_slice long, _size long, _blob binary")
    packed.write.bucketBy(buckets, "_slice").option("path", work_dir(spark, name)).format("parquet").saveAsTable(name)
    return spark.table(name)


def opened_slice(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids, whether there is one, and texts."""
    (ids, has, sizes), data = unpack(blob, "q?q")
    ends = np.cumsum(sizes)
    return ids, has, [data[a:z] for a, z in zip((ends - sizes).tolist(), ends.tolist())]


def pieces_of(has: np.ndarray, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Documents that have an id as numbers, offsets and pieces, about ``SLICE`` bytes at a time.

    Pieces of a longer text share ``SPAN - 1`` bytes, so each string is in one piece.
    """
    held, size = [], 0
    for i in np.flatnonzero(has).tolist():
        data = texts[i]
        for base in range(0, len(data) - SPAN + 1, SLICE):
            held.append((i, base, data[base : base + SLICE + SPAN - 1]))
            size += len(held[-1][2])
            if size >= SLICE:
                yield _columns(held)
                held, size = [], 0
    if held:
        yield _columns(held)


def _columns(held: list) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    numbers, bases, texts = zip(*held)
    return np.array(numbers, np.int64), np.array(bases, np.int64), list(texts)


def pack(arrays: list[np.ndarray], data: bytes = b"") -> bytes:
    """Arrays byte by byte (all first bytes, then all second ones, ...), which compresses small numbers best."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays]
    raw = b"".join([struct.pack(f"<{len(arrays)}q", *map(len, arrays)), *planes, data])
    return zstandard.ZstdCompressor(LEVEL).compress(raw)


def unpack(blob: bytes, kinds: str) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, arrays = 8 * len(kinds), []
    for kind, size in zip(kinds, struct.unpack_from(f"<{len(kinds)}q", raw)):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        arrays.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size * width
    return arrays, raw[at:]


def _halves_of(ids: np.ndarray, has: np.ndarray, texts: list[bytes], bits: int):
    """Sorted distinct hashes of a slice's halves, in how many fragments each is, and whether under several ids."""
    keys, owners = [], []
    for numbers, _, held in pieces_of(has, texts):
        cut = Fragments(held)
        _, hashes = cut.halves()
        for side in hashes:
            which = np.flatnonzero(side)
            keys.append(side[which] >> np.uint64(64 - bits))
            owners.append(ids[numbers[cut.piece[which]]])
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    several = np.maximum.reduceat(owner, heads) != np.minimum.reduceat(owner, heads)
    return key[heads], np.diff(np.append(heads, len(key))), several


def _asked(slices: DataFrame, bits: int, buckets: int) -> DataFrame:
    """``_bucket, _slice, _asked``: the halves of each slice, by ranges of their hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for slice_, blob in zip(batch["_slice"], batch["_blob"]):
                key, n, several = _halves_of(*opened_slice(blob), bits)
                flags = np.minimum(n, 127).astype(np.uint8) | several.astype(np.uint8) << 7
                edge = np.searchsorted(key, _edges(bits, buckets))
                rows = [
                    (k, slice_, pack([np.diff(key[a:z], prepend=np.uint64(0)), flags[a:z]]))
                    for k, (a, z) in enumerate(zip(edge[:-1], edge[1:]))
                    if z > a
                ]
                if rows:
                    yield pd.DataFrame(rows, columns=["_bucket", "_slice", "_asked"])

    return slices.select("_slice", "_blob").mapInPandas(run, "_bucket long, _slice long, _asked binary")


def _edges(bits: int, buckets: int) -> np.ndarray:
    return np.array([(k << bits) // buckets for k in range(buckets)] + [1 << bits], np.uint64)


#: What is known of a half: no other document has it; one has; it is hot.
NONE, SOME, MANY = 0, 1, 2


def _replied(asked: DataFrame) -> DataFrame:
    """``_slice, _bucket, _status``: what is known of each half, in the order in which a slice asked."""

    def answer(slices: list[int], blobs: list[bytes], bucket: int) -> pd.DataFrame:
        keys, flags = zip(*(unpack(b, "QB")[0] for b in blobs))
        key, flag = np.concatenate([np.cumsum(k, dtype=np.uint64) for k in keys]), np.concatenate(flags)
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        n = np.diff(np.append(heads, len(key)))
        flag = flag[order]
        total = np.add.reduceat((flag & 127).astype(np.int64), heads)
        known = np.where((n > 1) | (np.maximum.reduceat(flag, heads) > 127), SOME, NONE)
        known[(known == SOME) & (total > HOT)] = MANY
        status = np.empty(len(key), np.uint8)
        status[order] = np.repeat(known, n)
        parts = np.split(status, np.cumsum([len(k) for k in keys])[:-1])
        return pd.DataFrame({"_slice": slices, "_bucket": bucket, "_status": [pack([p]) for p in parts]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for bucket, rows in _buckets(batches):
            yield answer([r[1] for r in rows], [r[2] for r in rows], bucket)

    by = asked.repartition("_bucket").sortWithinPartitions("_bucket")
    return by.mapInPandas(run, "_slice long, _bucket long, _status binary")


def _buckets(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of one bucket after the other, from rows sorted by bucket, their first column."""
    held: list[tuple] = []
    for batch in batches:
        for row in batch.itertuples(index=False, name=None):
            if held and held[0][0] != row[0]:
                yield held[0][0], held
                held = []
            held.append(row)
    if held:
        yield held[0][0], held


#: Lengths of fragments, the id that a slice ships each for; per place of it fragment, document and place.
_SHIPPED = "Bqiii"


def deal(ids: np.ndarray, has: np.ndarray, texts: list[bytes], status: np.ndarray, bits: int, buckets: int):
    """``(bucket, blob)`` of a slice's fragments that may repeat, and last ``(None, marks)`` of those of larger ids."""
    parts, key = [], None
    for numbers, bases, held in pieces_of(has, texts):
        if key is None:
            key = _halves_of(ids, has, texts, bits)[0]
        cut = Fragments(held)
        split, hashes = cut.halves()
        known = np.zeros(hashes.shape, np.uint8)
        for side in (0, 1):
            which = np.flatnonzero(hashes[side])
            known[side, which] = status[np.searchsorted(key, hashes[side, which] >> np.uint64(64 - bits))]
        route = hash_bytes(words_at(cut.data), cut.anchor, GRAM)
        both = (known == SOME).all(axis=0)
        runs = [(cut.start[both], cut.strings[both], route[both], cut.piece[both])]
        for side, start, n in ((0, cut.start, split), (1, cut.start + split, cut.strings - split)):
            one = (known[side] == SOME) & ~both
            runs.append((start[one], n[one], route[one], cut.piece[one]))
            hot = known[side] == MANY
            m = n[hot]
            single = np.repeat(start[hot], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            whole = hash_bytes(words_at(cut.data), single, SPAN)
            runs.append((single, np.ones(len(single), np.int64), whole, np.repeat(cut.piece[hot], m)))
        start, strings, route, piece = (np.concatenate(c) for c in zip(*runs))
        place = start - cut.first[piece] + bases[piece]
        parts.append((cut.data, start, strings, route, numbers[piece], place))
    if not parts:
        return
    of = np.concatenate([np.full(len(p[1]), k) for k, p in enumerate(parts)])
    start, strings, route, number, place = (np.concatenate([p[k] for p in parts]) for k in range(1, 6))
    to = ((route >> np.uint64(11)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((place, number, to))  # documents are numbered in the order of ids
    of, start, strings, number, place, to = (x[order] for x in (of, start, strings, number, place, to))
    stop, own = start + strings + SPAN - 1, ids[number]
    repeated = np.zeros(len(of), bool)
    datas = [p[0] for p in parts]
    borders = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True]))) if len(to) else []
    for low, high in zip(borders, borders[1:]):
        found: dict[bytes, int] = {}
        least, owner, kept = [], [], []
        for i, k, a, z, id_ in zip(
            range(low, high), of[low:high].tolist(), start[low:high].tolist(), stop[low:high].tolist(), own[low:high].tolist()
        ):
            n = found.setdefault(datas[k][a:z], len(found))
            if n == len(least):
                least.append(id_)
            elif id_ > least[n]:
                repeated[i] = True
                continue
            owner.append(n)
            kept.append(i)
        yield int(to[low]), pack(
            [
                np.array([len(f) for f in found], np.uint8), np.array(least, np.int64), np.array(owner, np.int32),
                number[kept].astype(np.int32), place[kept].astype(np.int32),
            ],
            b"".join(found),
        )
    if repeated.any():
        yield None, (number[repeated], place[repeated], strings[repeated])


def sort_suffixes(
    data: np.ndarray, ends: np.ndarray, depth: int = SPAN, wanted: np.ndarray | None = None
) -> np.ndarray:
    """Suffixes of fragments in order of their first ``depth`` bytes, by two stages.

    ``data`` holds the fragments end to end, ``ends`` where each stops. A suffix stops with its
    fragment and is smaller than whatever continues it. Where only the first ``wanted`` suffixes of a
    fragment are asked for, those behind the next directly sorted one are left out: nothing is induced from them.
    """
    n, pieces = len(data), len(ends)
    # Bytes count from 1, a 0 stands behind each fragment.
    shift = np.zeros(n + 1, np.int32)
    np.add.at(shift, ends, 1)
    x = np.zeros(n + pieces, np.int16)
    x[np.arange(n, dtype=np.int32) + np.cumsum(shift[:n], dtype=np.int32)] = data.astype(np.int16) + 1
    # Is a suffix smaller than its successor? Equal letters ask the next one.
    step = np.sign(np.append(x[1:], np.int16(0)) - x)
    step[x == 0] = -1
    nearest = np.where(step != 0, np.arange(len(x), dtype=np.int32), np.int32(len(x) - 1))
    smaller = step[np.minimum.accumulate(nearest[::-1])[::-1]] > 0
    del nearest, step

    behind = np.flatnonzero(x == 0)  # the place behind each fragment
    last = behind
    if wanted is not None:
        following = np.where(smaller, np.arange(len(x), dtype=np.int32), np.int32(len(x) - 1))
        following = np.minimum.accumulate(following[::-1])[::-1]
        last = np.minimum(following[ends - np.diff(ends, prepend=0) + np.arange(pieces) + wanted], behind)
        del following
    fragment = np.cumsum(x == 0, dtype=np.int32) - (x == 0)
    direct = np.flatnonzero(smaller & (np.arange(len(x), dtype=np.int32) <= last[fragment]))
    direct = direct[_order(x, direct, depth)]
    sorted_direct = np.split(direct, np.searchsorted(x[direct], np.arange(1, 257)))
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]

    def induce(at: np.ndarray, letter: int) -> np.ndarray:
        """Larger predecessors of placed suffixes go to the ends of their buckets; those of this one are returned."""
        before = at[at > 0] - 1
        before = before[~smaller[before] & (x[before] > 0)]
        rank = np.argsort(x[before], kind="stable")
        before = before[rank]
        to = x[before]
        own = before[:0]
        borders = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True]))) if len(to) else []
        for low, high in zip(borders, borders[1:]):
            if to[low] == letter:
                own = before[low:high]
            else:
                induced[to[low]].append(before[low:high])
        return own

    out = []
    induce(behind[last == behind], 0)
    for letter in range(1, 257):
        run = np.concatenate(induced[letter]) if induced[letter] else direct[:0]
        induced[letter] = []
        while len(run):
            out.append(run)
            run = induce(run, letter)
        if len(sorted_direct[letter]):
            out.append(sorted_direct[letter])
            induce(sorted_direct[letter], letter)
    found = np.concatenate(out) if out else direct
    return found - fragment[found]  # places without the zeros


def _letters(x: np.ndarray, n: int) -> np.ndarray:
    """At every place ``n`` letters as one number, zeros from the end of the fragment on."""
    out = x.astype(np.int64)
    for j in range(1, n):
        out = x * np.int64(257**j) + np.where(x > 0, np.append(out[1:], 0), 0)
    return out


def _order(x: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The order of suffixes by ``depth`` letters.

    Equal ones are brought together by a hash and compared; one of each run is sorted.
    """
    letters = _letters(x, 7)
    zeros = np.flatnonzero(x == 0)
    stop = zeros[np.searchsorted(zeros, at)]

    def seven(which: np.ndarray, k: int) -> np.ndarray:
        here = at[which] + k
        return np.where(here < stop[which], letters[np.minimum(here, len(x) - 1)], 0)

    offsets = (*range(0, depth - 7, 7), depth - 7)
    every = np.arange(len(at), dtype=np.uint64)
    mixed = np.zeros(len(at), np.uint64)
    for k in offsets:
        mixed = (mixed ^ seven(every.view(np.int64), k).view(np.uint64)) * _MIX[0]
        mixed ^= mixed >> np.uint64(29)
    bits = np.uint64(len(at).bit_length())
    together = (np.sort(mixed >> bits << bits | every) & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
    new = np.zeros(len(at), bool)
    new[:1] = True
    for k in offsets:
        value = seven(together, k)
        new[1:] |= value[1:] != value[:-1]
    heads = np.flatnonzero(new)
    rank = _sorted(letters, at[together[heads]], stop[together[heads]], len(x), depth)
    sizes = np.diff(np.append(heads, len(at)))[rank]
    first = np.cumsum(sizes) - sizes
    return together[np.repeat(heads[rank] - first, sizes) + np.arange(len(at))]


def _sorted(letters: np.ndarray, at: np.ndarray, stop: np.ndarray, size: int, depth: int) -> np.ndarray:
    """The order of suffixes that mostly differ: some letters a round, only what is tied goes on."""
    value = letters[at]
    order = np.argsort(value, kind="stable")
    step = 5 if len(at) < 1 << 22 else 4
    drop, scale = 257 ** (7 - step), 257**step
    # Tied suffixes form a group, named by the first of its places in the order.
    spots, moved, value = np.arange(len(at)), order.copy(), value[order]
    for k in range(7, depth + step, step):
        heads = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else spots
        sizes = np.diff(np.append(heads, len(moved)))
        tied = np.repeat(sizes > 1, sizes)
        group = np.repeat(spots[heads], sizes)[tied]
        spots, moved = spots[tied], moved[tied]
        if not len(moved) or k >= depth:
            break
        here = at[moved] + k
        value = np.where(here < stop[moved], letters[np.minimum(here, size - 1)] // drop, 0) + group * scale
        rank = np.argsort(value, kind="stable")
        moved, value = moved[rank], value[rank]
        order[spots] = moved
    return order


def common_prefixes(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = SPAN) -> np.ndarray:
    """Bytes, up to ``most``, that the suffixes at ``a`` and ``b`` share, where both have ``most``."""
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    for k in range(0, most, 8):
        differ = words[a[open_] + k].astype(np.uint64) ^ words[b[open_] + k].astype(np.uint64)
        # Leading equal bytes of a word: eight if it is zero.
        equal = np.zeros(len(open_), np.int64)
        for j in range(8):
            equal += differ < np.uint64(1 << (56 - 8 * j)) if j else differ < np.uint64(1 << 56)
        equal[differ == 0] = 8
        out[open_] += equal
        open_ = open_[differ == 0]
        if not len(open_):
            break
    return np.minimum(out, most)


def repeats(slices: list[int], blobs: list[bytes]):
    """Of one bucket ``slice, numbers, places, strings``: runs of strings that a smaller id holds as well."""
    columns: list[list[np.ndarray]] = [[] for _ in _SHIPPED]
    datas, count, shipped = [], 0, []
    for blob in blobs:
        arrays, data = unpack(blob, _SHIPPED)
        arrays[2] = arrays[2] + count
        for held, new in zip(columns, arrays):
            held.append(new)
        datas.append(data)
        count += len(arrays[0])
        shipped.append(len(arrays[2]))
    length, least, owner, numbers, places = (np.concatenate(c) for c in columns)
    raw = b"".join(datas)
    del columns, datas
    length = length.astype(np.int64)
    ends = np.cumsum(length)
    first = ends - length
    suffix = sort_suffixes(np.frombuffer(raw, np.uint8), ends, wanted=length - SPAN + 1)
    piece = np.searchsorted(ends, suffix, "right")
    whole = ends[piece] - suffix >= SPAN
    suffix, own = suffix[whole], least[piece[whole]]
    del piece, whole
    shared = common_prefixes(words_at(raw + bytes(8)), suffix[:-1], suffix[1:]) >= SPAN
    heads = np.flatnonzero(np.concatenate(([True], ~shared)))
    smallest = np.repeat(np.minimum.reduceat(own, heads), np.diff(np.append(heads, len(suffix))))
    gone = np.zeros(len(raw) + 1, np.int8)
    gone[suffix[smallest < own]] = 1
    # No string starts in the last places of a fragment, so a run stops there at the latest.
    edge = np.diff(gone, prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return
    piece = np.searchsorted(ends, begin, "right")
    # A run holds at every place of its fragment; fragments of a slice stand together.
    here = np.argsort(owner, kind="stable")
    low = np.searchsorted(owner[here], piece, "left")
    n = np.searchsorted(owner[here], piece, "right") - low
    run = np.repeat(np.arange(len(begin)), n)
    at = here[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    places, strings = places[at] + (begin - first[piece])[run], (end - begin)[run]
    of = np.searchsorted(np.cumsum(shipped), at, "right")
    borders = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
    for a, z in zip(borders, borders[1:]):
        yield slices[of[a]], numbers[at[a:z]], places[a:z], strings[a:z]


def _mark(numbers: np.ndarray, places: np.ndarray, strings: np.ndarray) -> bytes:
    return pack([numbers.astype(np.int32), places.astype(np.int32), strings.astype(np.int32)])


def _dealt(slices: DataFrame, replies: DataFrame, bits: int, buckets: int) -> DataFrame:
    """``_bucket, _slice, _blob, _marks``: fragments of each slice and bucket; marks travel along."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for slice_, blob, parts in zip(batch["_slice"], batch["_blob"], batch["_status"]):
                status = np.concatenate([unpack(p, "B")[0][0] for p in parts]) if parts is not None else None
                rows = []
                for bucket, found in deal(*opened_slice(blob), status, bits, buckets):
                    if bucket is None:
                        rows.append((slice_ % buckets, slice_, _mark(*found), True))
                    else:
                        rows.append((bucket, slice_, found, False))
                if rows:
                    yield pd.DataFrame(rows, columns=["_bucket", "_slice", "_blob", "_marks"])

    status = replies.groupBy("_slice").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_status"))), lambda p: p["_status"]).alias("_status")
    )
    joined = slices.select("_slice", "_blob").join(status, "_slice")
    return joined.mapInPandas(run, "_bucket long, _slice long, _blob binary, _marks boolean")


def _found(dealt: DataFrame) -> DataFrame:
    """``_slice, _mark``: marks of every bucket, one bucket in memory at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _buckets(batches):
            out = [(slice_, blob) for _, slice_, blob, marks in rows if marks]
            shipped = [(slice_, blob) for _, slice_, blob, marks in rows if not marks]
            if shipped:
                out += [(found[0], _mark(*found[1:])) for found in repeats(*zip(*shipped))]
            if out:
                yield pd.DataFrame(out, columns=["_slice", "_mark"])

    return dealt.repartition("_bucket").sortWithinPartitions("_bucket").mapInPandas(run, "_slice long, _mark binary")


def spans_of(places: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that the strings cover: starts and stops."""
    order = np.argsort(places, kind="stable")
    start, stop = places[order], (places + strings)[order] + SPAN - 1
    reach = np.maximum.accumulate(stop)
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans, kept``: removed byte ranges ``array<struct<start, stop>>`` and the bytes that stay, of every row.

    Kept bytes are binary, since a span may start or stop inside a character.
    """
    slices = packed_slices(docs, id_col, text_col)
    size = slices.agg(F.sum("_size")).first()[0] or 0
    halves = size // 10  # two for about 20 strings
    bits = min(62, max(24, 14 + halves.bit_length()))
    replies = _replied(_asked(slices, bits, 1 + halves // HASHES))
    marks = _found(_dealt(slices, replies, bits, 1 + 7 * size // 2 // BUCKET))
    marks = marks.groupBy("_slice").agg(F.collect_list("_mark").alias("_marks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob, found in zip(batch["_blob"], batch["_marks"]):
                yield _cleaned(blob, [] if found is None else found)

    result = "doc_id string, spans array<struct<start: long, stop: long>>, kept binary"
    rows = slices.select("_slice", "_blob").join(marks, "_slice", "left").mapInPandas(run, result)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def _cleaned(blob: bytes, marks: list[bytes]) -> pd.DataFrame:
    ids, has, texts = opened_slice(blob)
    none = [np.empty(0, np.int32)] * 3
    number, place, strings = (np.concatenate(c) for c in zip(none, *(unpack(m, "iii")[0] for m in marks)))
    order = np.argsort(number, kind="stable")
    place, strings = place[order].astype(np.int64), strings[order].astype(np.int64)
    edges = np.searchsorted(number[order], np.arange(len(texts) + 1))
    spans, kept = [], []
    for data, a, z in zip(texts, edges, edges[1:]):
        starts, stops = (x.tolist() for x in spans_of(place[a:z], strings[a:z])) if z > a else ([], [])
        spans.append([{"start": x, "stop": y} for x, y in zip(starts, stops)])
        kept.append(b"".join([data[x:y] for x, y in zip([0, *stops], [*starts, len(data)])]))
    return pd.DataFrame({"doc_id": [str(i) if h else None for i, h in zip(ids, has)], "spans": spans, "kept": kept})


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return remove_repeats(docs, id_col, text_col).select(
        "doc_id",
        (F.octet_length("kept").cast("long") + gone).alias("n_bytes"),
        gone.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (
  SELECT doc_id, h, unnest(range(greatest(length(h) // 2 - 49, 0))) AS p FROM d),
strings AS (SELECT doc_id, p, md5(substring(h, 2 * p + 1, 100)) AS s FROM places),
smallest AS (SELECT s, min(doc_id) AS least FROM strings GROUP BY s HAVING count(DISTINCT doc_id) > 1),
found AS (SELECT doc_id, p FROM strings JOIN smallest USING (s) WHERE least < doc_id),
edges AS (
  SELECT doc_id, p,
         coalesce(p > lag(p) OVER w + 50, true) AS starts,
         coalesce(lead(p) OVER w > p + 50, true) AS stops
  FROM found WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
spans AS (
  SELECT a.doc_id, a.p AS start, z.p + 50 AS stop
  FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM edges WHERE starts) a
  JOIN (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM edges WHERE stops) z
  USING (doc_id, k)),
kept AS (
  SELECT doc_id, sum(stop - start) AS n_removed, count(*) AS n_spans,
         list(start ORDER BY start) AS starts, list(stop ORDER BY start) AS stops
  FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(
         range(CAST(n_spans AS BIGINT) + 1),
         lambda i: substring(h,
           2 * (CASE WHEN i = 0 THEN 0 ELSE stops[i] END) + 1,
           2 * ((CASE WHEN i = n_spans THEN length(h) // 2 ELSE starts[i + 1] END)
                - (CASE WHEN i = 0 THEN 0 ELSE stops[i] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
