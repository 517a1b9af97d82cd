import base64
import random
import tracemalloc

from hypothesis import given, settings, strategies as st
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokengrove.functions import tokens
from tokengrove.functions.code import wrap_code
from tokengrove.functions.formats import fmt_compact, fmt_map
from tokengrove.functions.text import json_text, trim_all
from tokengrove.functions.tokens import ENCODINGS, bpe_tokens, merged_length, register_tokenizer


def test_formats(spark):
    # Either side of every border of the rule, and of the two units.
    borders = [500 * 10**k * n for k in (0, 3) for n in range(1, 42)] + [10**3, 10**6]
    numbers = sorted({b + d for b in borders for d in (-1, 0, 1)})

    def rounded(n):
        unit = 1 if n < 1000 else 1000 if n < 10**6 else 10**6
        return f"{(2 * n + unit) // (2 * unit)}" + {1: "", 1000: "K", 10**6: "M"}[unit]

    rows = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", fmt_map(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in rows} == {n: rounded(n) for n in numbers}
    rows = spark.range(0, 30000).select("id", fmt_compact(F.col("id")).alias("s")).collect()
    for r in rows:
        n = r.id
        expected = str(n) if n < 1000 else f"{n / 1000:.1f}k" if n < 10000 else f"{n / 1000:.0f}k"
        assert r.s == expected


def test_wrap(spark):
    cases = [
        ("a\nb\n", "py", False, False, "```py\na\nb\n```"),
        ("a\nb", "py", False, False, "```py\na\nb```"),
        ("a\nb\n", "py", True, False, "```py\n   1 | a\n   2 | b\n```"),
        ("a\r\nb", "", True, False, "```\n   1 | a\n   2 | b\n```"),
        ("a\nb\r", None, True, False, "```\n   1 | a\n   2 | b\r\n```"),
        ("a\nb", "py", True, True, "a\nb"),
        ("", "py", True, False, "```py\n```"),
        ("\n\n", "py", True, False, "```py\n   1 | \n   2 | \n```"),
    ]
    for content, ext, numbers, bare, expected in cases:
        df = spark.createDataFrame([(content, ext)], "c string, e string")
        assert df.select(wrap_code(F.col("c"), F.col("e"), numbers, bare)).first()[0] == expected
    long = spark.createDataFrame([("x\n" * 10001, "t")], "c string, e string")
    assert "\n10000 | x\n" in long.select(wrap_code(F.col("c"), F.col("e"), True)).first()[0]


def test_text(spark):
    df = spark.createDataFrame([("  \n a\tb \x85　", 'q"\\\né\t')], "a string, b string")
    row = df.select(trim_all(F.col("a")).alias("a"), json_text(F.col("b")).alias("b")).first()
    assert row.a == "a\tb" and row.b == 'q\\"\\\\\\né\\t'


# ── byte pairs ───────────────────────────────────────────────────────────────


def naive(piece: bytes, ranks) -> int:
    if piece in ranks:
        return 1
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(
            ((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks),
            default=None,
        )
        if best is None:
            return len(parts)
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def vocabulary(words):
    ranks = {bytes([b]): b for b in range(256)}
    for word in words:
        for end in range(2, len(word) + 1):
            ranks.setdefault(word[:end], len(ranks))
    return ranks


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.text(alphabet="ab é", min_size=2, max_size=5).map(str.encode), max_size=12),
    st.text(alphabet="ab é", min_size=1, max_size=40).map(str.encode),
)
def test_merging_equals_the_naive_search(words, piece):
    ranks = vocabulary(words)
    assert merged_length(piece, ranks) == naive(piece, ranks)


def test_long_piece_is_fast():
    assert merged_length(b"a" * 1_000_000, vocabulary([b"aa", b"aaaa"])) == 250_000


TEXTS = [
    "Hello world, it's 12345 o'clock!\n\n\n  def f(x):\n\treturn x+1;  \n",
    "ünïcödé ÀÉ mixedCase HTTPServer don't WE'RE\r\n\r\n   trailing   ",
    "<|endoftext|>.<|endofprompt|>",
    "",
    "a" * 50 + "/" * 10 + "\n//\n",
    "　 x  y",
]


@pytest.mark.parametrize("name", sorted(ENCODINGS))
def test_counts_equal_the_public_encoder(spark, name):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = vocabulary([b"Hello", b" world", b"the", b" x", b"\n\n", b"  ", "é".encode(), b"aaaa", b"12", b"'s"])
    tok = register_tokenizer(name, ranks=ranks)
    specials = {s: len(ranks) + i for i, s in enumerate(tok.specials)}
    # the same pattern without the JVM's flag; that engine is Unicode-aware by itself
    enc = tiktoken.Encoding(name, pat_str=tok.pattern.replace("(?U)", ""), mergeable_ranks=ranks, special_tokens=specials)
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r.t: r.n for r in df.select("t", bpe_tokens(spark, F.col("t"), tok).alias("n")).collect()}
    for text in TEXTS:
        assert got[text] == len(enc.encode(text, allowed_special="all")), text


def test_vocabulary_file(spark, tmp_path):
    ranks = vocabulary([b"ab", b"abc"])
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in ranks.items()))
    tok = register_tokenizer("gpt2", str(path))
    assert tok.name == "r50k_base" and tok.ranks == ranks
    with pytest.raises(ValueError):
        register_tokenizer("mine", ranks=ranks)
    with pytest.raises(ValueError):
        register_tokenizer("mine", ranks={b"a": 0}, pattern=".")
    df = spark.createDataFrame([(None,), ("abc abc",)], "t string")
    assert [r[0] for r in df.select(bpe_tokens(spark, F.col("t"), tok)).collect()] == [None, 3]


def test_pieces_are_counted_a_bounded_number_at_a_time(monkeypatch):
    rng = random.Random(6)
    lists = [None if rng.random() < 0.1 else [rng.choice("abcdef") * rng.randrange(1, 4) for _ in range(rng.choice([0, 0, 1, 5, 40]))] for _ in range(300)]
    want = [None if x is None else sum(map(len, x)) for x in lists]
    made = pa.array(lists, pa.list_(pa.string()))
    for at_once in (1, 7, 64, 1 << 18):
        monkeypatch.setattr(tokens, "AT_ONCE", at_once)
        assert tokens.row_sums(made, len).to_pylist() == want
        assert tokens.row_sums(made.slice(11, 200), len).to_pylist() == want[11:211]
    assert tokens.row_sums(made.slice(0, 0), len).to_pylist() == []
    many = pa.ListArray.from_arrays(np.array([0, 3_000_000], np.int32), pa.array(["ab", "c", "d"] * 1_000_000))
    tracemalloc.start()
    assert tokens.row_sums(many, len).to_pylist() == [4_000_000]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20, peak  # arrays over all three million took 72 MB
