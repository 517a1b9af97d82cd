"""Suffix sorting and removal of repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tokengrove.llm import suffix_dedup as sd
from tokengrove.llm.queries import ORACLES, QUERIES
from oracle import compare, connect
from .conftest import prose


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abc d\x00\xff", bytes(range(256))])
def test_order_of_suffixes(letters):
    rng = random.Random(len(letters))
    for _ in range(15):
        pieces = [bytes(rng.choices(letters, k=rng.randint(1, 90))) for _ in range(rng.randint(1, 30))]
        pieces += [p[: rng.randint(1, len(p))] for p in pieces[:5]] + [letters[:1] * 88]
        data, ends = b"".join(pieces), np.cumsum([len(p) for p in pieces])
        found = sd.sort_suffixes(np.frombuffer(data, np.uint8), ends).tolist()
        assert sorted(found) == list(range(len(data)))
        heads = [data[p : min(ends[np.searchsorted(ends, p, "right")], p + sd.SPAN)] for p in found]
        assert heads == sorted(heads)
        sizes = np.diff(ends, prepend=0)
        wanted = np.array([rng.randint(0, n) for n in sizes])
        some = sd.sort_suffixes(np.frombuffer(data, np.uint8), ends, wanted=wanted).tolist()
        asked = {p for e, n, w in zip(ends.tolist(), sizes.tolist(), wanted.tolist()) for p in range(e - n, e - n + w)}
        assert asked <= set(some) and len(some) == len(set(some))
        # As far as a suffix is needed it is in order: to the end of what is asked for.
        heads = [data[p : p + sd.SPAN] for p in some if p in asked and p + sd.SPAN <= ends[np.searchsorted(ends, p, "right")]]
        assert heads == sorted(heads)


def test_common_prefixes():
    rng = random.Random(3)
    data = bytes(rng.choices(b"ab", k=3000))
    data = data[:1000] + data[:1000] + data
    words = sd.words_at(data + bytes(8))
    a, b = (np.array(rng.choices(range(len(data) - 60), k=300)) for _ in range(2))
    b[::3] = np.minimum(a[::3] + 1000, len(data) - 60)
    shared = [next((k for k in range(sd.SPAN) if data[x + k] != data[y + k]), sd.SPAN) for x, y in zip(a, b)]
    assert sd.common_prefixes(words, a, b).tolist() == shared


def test_anchors_depend_on_the_string_only():
    data = (prose(2, 400) * 2).encode()
    found = sd.anchors(data + bytes(8))
    seen = {}
    for i, at in enumerate(found.tolist()):
        assert i <= at <= i + sd.SPAN - sd.GRAM
        assert seen.setdefault(data[i : i + sd.SPAN], at - i) == at - i


def brute(rows):
    """Results by all strings of all rows; ``rows`` are ids and texts."""
    least, out = {}, []
    rows = [(i, (t or "").encode()) for i, t in rows]
    for i, data in rows:
        for p in range(len(data) - sd.SPAN + 1) if i is not None else ():
            s = data[p : p + sd.SPAN]
            least[s] = min(least.get(s, i), i)
    for i, data in rows:
        gone = bytearray(len(data))
        for p in range(len(data) - sd.SPAN + 1) if i is not None else ():
            if least[data[p : p + sd.SPAN]] < i:
                gone[p : p + sd.SPAN] = b"\1" * sd.SPAN
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(
        ((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=str
    )


def passages(n):
    rng = random.Random(n)
    shared = [prose(100 + k, 12) for k in range(6)] + ["- - - all rights reserved, thé énd of thiß page - - -"]
    rows = []
    for i in range(n):
        parts = [prose(1000 + 10 * i + k, rng.randint(1, 25)) + "".join(rng.choices("xyzß", k=3)) for k in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(shared))
        parts.append(shared[-1])
        rows.append((rng.randint(0, n // 2) if i % 9 == 0 else i, " ".join(parts)))
    rows += [(n + 1, rows[3][1]), (n + 2, rows[4][1][5:]), (n + 3, "x" * 300), (n + 4, "x" * 120), (n + 5, "ab" * 40)]
    return rows


@pytest.mark.parametrize("setting", ["whole", "hot", "small"])
def test_removal(spark, monkeypatch, setting):
    if setting == "hot":  # anchors of the common line are dealt string by string
        monkeypatch.setattr(sd, "HOT", 3)
    if setting == "small":  # many slices, texts in pieces, many buckets
        monkeypatch.setattr(sd, "SLICE", 100)
        monkeypatch.setattr(sd, "BUCKET", 2000)
        monkeypatch.setattr(sd, "HASHES", 100)
    rows = passages(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(sd.repeat_digests(docs)) == brute(rows)


def test_spans_and_kept_bytes(spark):
    passage = prose(7, 20)
    rows = [(5, f"one {passage} two"), (2, passage), (9, "öä" + passage)]
    got = {r["doc_id"]: r for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2]["spans"] == [] and got[2]["kept"] == passage.encode()
    for i, text in rows:
        data, kept, at = text.encode(), b"", 0
        for start, stop in got[i]["spans"]:
            kept, at = kept + data[at:start], stop
        assert kept + data[at:] == got[i]["kept"]
    assert got[9]["kept"] == "öä".encode()


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found(sd.repeat_digests(odd_docs)) == brute(rows)
    assert sd.repeat_digests(no_docs).count() == 0
    assert sd.repeat_digests(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 2


def test_query(spark, small):
    name = "op11_suffix_dedup"
    assert compare(QUERIES[name](spark, small), connect(small), ORACLES[name]) is None
