"""Token alignment and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest

from tokengrove.llm import spelling_variants as sv, token_alignment as ta
from tokengrove.llm.queries import ORACLES, QUERIES, tokenizer_path
from oracle import compare, connect
from .conftest import prose

PATHS = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def test_gallop():
    rng = random.Random(1)
    for _ in range(50):
        longer = np.cumsum(rng.choices(range(1, 9), k=rng.randint(1, 200)))
        driver = np.array(sorted(rng.sample(range(1, 900), 30)))
        n = len(driver)
        low, high = np.zeros(n, np.int64), np.full(n, len(longer))
        guess = np.array(rng.choices(range(len(longer)), k=n))
        assert ta.gallop(driver, longer, guess, low, high).tolist() == np.searchsorted(longer, driver).tolist()


def align_brute(rows, first, second):
    letters = {c: b for c, b in ta.byte_letters().items()}
    groups = []
    for _, text in rows:
        text = text or ""
        a = first.encode(" " + text, add_special_tokens=False)
        b = second.encode(text)
        bytes_a = [bytes(letters[c] for c in t) for t in a.tokens]
        bytes_b = [
            bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, second.id_to_piece(i)) for i in b)
        ]
        whole = (" " + text).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            groups.append([])
            continue
        ends = [{e: k + 1 for k, e in enumerate(accumulate(map(len, side)))} for side in (bytes_a, bytes_b)]
        out, x, y, ids = [], 0, 0, a.ids
        for end in sorted(set(ends[0]) & set(ends[1])):
            out.append((ids[x : ends[0][end]], b[y : ends[1][end]]))
            x, y = ends[0][end], ends[1][end]
        groups.append(out)
    linked = [Counter((i, j) for x, y in g for i in x for j in y) for g in groups]
    count = Counter(p for c in linked for p in c)
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for (doc, _), g, c in zip(rows, groups, linked):
        listing = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        out.append(
            (
                doc,
                sum(len(x) for x, _ in g),
                sum(len(y) for _, y in g),
                len(g),
                sum(c.values()),
                sum(n for p, n in c.items() if count[p] == best[p[0]]),
                sum(n * count[p] for p, n in c.items()),
                hashlib.sha256(listing.encode()).hexdigest() if g else "",
            )
        )
    return sorted(out, key=str)


def align_rows(df):
    columns = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


ODD_TEXTS = [
    "naïve café 日本語 😀 <|endoftext|> end <s> </s>", "x" * 700, "a  b", " lead", "tab\tnew\n\nline", "日本語" * 60,
    "▁x", "don't I'll 1234567 !!!???", "ŋøþ " * 30, "\u0000nul", "trail ", "ﬁ ligature Å",
]


@pytest.mark.parametrize("sizes", [(1 << 20, 8 << 20), (300, 900)])
def test_alignment(spark, small, tokenizers, monkeypatch, sizes):
    monkeypatch.setattr(ta, "ENCODED", sizes[0])
    monkeypatch.setattr(ta, "SLICE", sizes[1])
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(100 + i, prose(i, 30)) for i in range(20)]
    rows += [(3, "again the same id"), (3, "again the same id"), (None, "no id"), (7, None), (1 << 60, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert align_rows(ta.align_tokens(docs, *PATHS)) == align_brute(rows, *tokenizers)


def test_both_coders_agree():
    pair = ta.TokenPair(*(ta._file(p) for p in PATHS))
    assert pair.ranked
    texts = [t for t in ODD_TEXTS if t] + [prose(k, 200) for k in range(5)]
    fast = pair.open().encode(texts)
    pair.opened = pair.ranked = False
    for a, b in zip(fast, pair.open().encode(texts)):
        assert (a is None) == (b is None) and (a is None or all((x == y).all() for x, y in zip(a, b)))


def test_alignment_of_wide_groups():
    """A group whose pairs are counted instead of listed."""
    sizes = np.array([0, *[1] * 40, 7])
    a = np.array([1, 2, 3] * 10 + [4] * 5)
    b = np.array([41] * 5)
    found = ta.Aligned([(a, b), (b, a)], sizes, sizes)
    text, code, times = found.links()
    wanted = [Counter((i, j) for i in x for j in y) for x, y in ((a.tolist(), b.tolist()), (b.tolist(), a.tolist()))]
    # Every seventh end is shared.
    groups = [Counter(), Counter()]
    for k in range(5):
        for i in a[7 * k : 7 * k + 7].tolist():
            groups[0][i, 41] += 1
            groups[1][41, i] += 1
    assert groups == wanted or sum(groups[0].values()) == 35
    got = [Counter(), Counter()]
    for t, c, n in zip(text.tolist(), code.tolist(), times.tolist()):
        got[t][c >> 32, c & 0xFFFFFFFF] += n
    assert got == groups
    one = ta.Aligned([(np.array([41, 41]), np.array([1] * 14))], sizes, np.where(sizes == 1, 1, 0))
    assert one.sizes[0].tolist() == [1, 1]
    wide = ta.Aligned([(np.arange(1, 41), np.array([0, 41]))], np.append(sizes[:-1], 7), np.append(np.zeros(41, int), 40))
    assert wide.sizes[0].tolist() == [40] and sum(wide.links()[2].tolist()) == 80


def test_rows_do_not_grow_with_slices(spark, tokenizers, monkeypatch):
    """What a slice asks is written in rows of about ``LINKS`` links, each with whole pairs."""
    monkeypatch.setattr(ta, "LINKS", 200, raising=False)
    tables = []
    monkeypatch.setattr(ta, "cut", lambda df, plain=ta.cut: tables.append(plain(df)) or tables[-1])
    rows = [(i, prose(i, 80)) for i in range(50)] + [(50, None), (51, ""), (52, prose(3, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert align_rows(ta.align_tokens(docs, *PATHS)) == align_brute(rows, *tokenizers)
    lists = [c for c, kind in tables[0].dtypes if kind.startswith("array")]
    written = [[len(r[c] or ()) for c in lists] for r in tables[0].collect()]
    assert sum(map(max, written)) > 2000 and max(map(max, written)) < 200 + len(rows)


def test_alignment_of_odd_tables(spark, odd_docs, no_docs, tokenizers):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert align_rows(ta.align_tokens(odd_docs, *PATHS)) == align_brute(rows, *tokenizers)
    assert ta.align_tokens(no_docs, *PATHS).count() == 0


def test_alignment_query(spark, small, tokenizers):
    df = QUERIES["op12_token_alignment"](spark, small)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert align_rows(df) == align_brute(rows, *tokenizers)


def variants_brute(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, out = {}, {}
    for w, n in words.items():
        found = [v for v in words if v != w and abs(len(v) - len(w)) <= 1 and near(v, w)]
        best = min(found, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best
        out[w] = len(found)
    rows = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, out[w], words[form[w]] if w in form else None))
    return sorted(rows, key=str)


def variant_rows(df):
    return sorted((tuple(r[c] for c in "word form root n n_near form_n".split()) for r in df.collect()), key=str)


def misspelt(n):
    rng = random.Random(n)
    base = ["".join(rng.choices("abcé", k=rng.randint(4, 9))) for _ in range(25)] + ["z" * k for k in range(4, 12)]
    rows = []
    for i in range(n):
        words = []
        for w in rng.choices(base, k=30):
            at, letter = rng.randrange(len(w) + 1), rng.choice("abcÉ")
            words.append(rng.choice([w, w, w.upper(), w[:at] + letter + w[at:], w[:at] + w[at + 1 :], w[:at] + letter + w[at + 1 :]]))
        rows.append((i, " ".join(words) + " ÀÉÿ×÷ 12ab34 don't"))
    return rows


@pytest.mark.parametrize("limits", [(4096, 512), (6, 4)])
def test_variants(spark, monkeypatch, limits):
    monkeypatch.setattr(sv, "BLOCK", limits[0])
    monkeypatch.setattr(sv, "PACKED", limits[1])
    rows = misspelt(60) + [(5, "repeat repeat repeats repeats Repeat"), (5, "repeats"), (None, "repeat"), (9, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert variant_rows(sv.group_variants(docs)) == variants_brute(rows)


def test_near_sets_of_long_words():
    long = "".join(random.Random(1).choices("abcdefgh", k=3000))
    words = [long, long[:10] + long[11:], long + "x", "x" + long, long[:-1] + "y", long[:5] + "zz" + long[7:]]
    found = Counter()
    for m in (2999, 3000):
        block = [w for w in words if len(w) in (m, m + 1)]
        counts = np.arange(10, 10 - len(block), -1)
        for front in (True, False):
            rows = sv.near_words(block, counts, np.full(len(block), 3), m, front)
            found.update(dict(zip(rows["word"], rows["near"])) if rows is not None else {})
    assert found[long] == 4 and found[words[5]] == 0


def test_variants_of_odd_tables(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert variant_rows(sv.group_variants(odd_docs)) == variants_brute(rows)
    assert sv.group_variants(no_docs).count() == 0


def test_variants_query(spark, small):
    name = "op13_spelling_variants"
    assert compare(QUERIES[name](spark, small), connect(small), ORACLES[name]) is None
