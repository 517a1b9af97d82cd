"""Language, quality, toxicity and encoding: brute force, held-out accuracy, exact round trips."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import pytest

from tokengrove.llm import language_id, quality_rules, toxicity, trie_bpe
from tokengrove.llm.base import WORD, table
from tokengrove.llm.queries import QUERIES, tokenizer_path
from .conftest import prose


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def model():
    return trie_bpe.read_model(tokenizer_path())


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    found = tokenizers.Tokenizer.from_file(tokenizer_path())
    found.no_truncation()
    found.no_padding()
    return found


def texts_of_all_kinds(n=400):
    rng = random.Random(5)
    kinds = [lambda: rng.randrange(32, 127), lambda: rng.randrange(0, 0xD800), lambda: rng.choice([32, 10, 9, 0xA0, 0x85])]
    made = ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randrange(1, 120))) for _ in range(n)]
    return made + [
        "", " ", "  a  b ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "I'll we've don't",
        "a" * 5000, " " * 999, "é" * 700, "\x00special\x00<|endoftext|>", "\x1c\x1d x", prose(2, 300),
    ]


def test_encoding_is_the_librarys(model, library):
    texts = texts_of_all_kinds()
    for text, ids in zip(texts, model.encode_batch(texts)):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == wanted
        assert model.decode(ids) == library.decode(wanted, skip_special_tokens=False)


def test_encoding_does_not_depend_on_what_was_seen(model):
    texts = texts_of_all_kinds(60)
    model._open()
    together = model.encode_batch(texts)
    for text, ids in zip(texts, together):
        model._open()
        assert model.encode_batch([text]) == [ids]


def test_walk_of_small_vocabulary_is_plain_merging():
    letters = sorted(trie_bpe.byte_letters())
    merges = [("a", "b"), ("b", "a"), ("a", "a"), ("ab", "ab"), ("ab", "a"), ("b", "b"), ("aa", "b")]
    vocab = {c: i for i, c in enumerate(letters)}
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    small = trie_bpe.BpeModel(
        {"model": {"type": "BPE", "vocab": vocab, "merges": merges}, "pre_tokenizer": {"type": "ByteLevel"}}
    )

    def merge(word):
        pieces = list(word)
        while True:
            ranked = [(merges.index(p), i) for i, p in enumerate(zip(pieces, pieces[1:])) if p in merges]
            if not ranked:
                return [vocab[p] for p in pieces]
            pair = merges[min(ranked)[0]]
            out, i = [], 0
            while i < len(pieces):
                if tuple(pieces[i : i + 2]) == pair:
                    out.append(pieces[i] + pieces[i + 1])
                    i += 2
                else:
                    out.append(pieces[i])
                    i += 1
            pieces = out

    rng = random.Random(3)
    words = {"".join(rng.choices("abc", weights=[4, 4, 1], k=rng.randint(1, 14))) for _ in range(1500)}
    for word, tokens in small.encode_distinct([w.encode() for w in words]):
        assert tokens == merge(word.decode()), word


def test_encoding_query(spark, small, library):
    got = {r["doc_id"]: r for r in QUERIES["op5_trie_bpe"](spark, small).collect()}
    rows = table(spark, small, "documents").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_encoding_odd_rows(odd_docs, no_docs, model, spark):
    rows = trie_bpe.digest_encoding(odd_docs, model).collect()
    assert len(rows) == 10
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert trie_bpe.digest_encoding(no_docs, model).count() == 0
    ids = odd_docs.select("doc_id", "text", trie_bpe.encode_column(spark, odd_docs["text"], model).alias("ids"))
    back = ids.select("text", trie_bpe.decode_column(spark, ids["ids"], model).alias("back")).collect()
    assert all((r["text"] or "") == r["back"] for r in back)


def test_language_accuracy_on_held_out_rows(spark, small):
    truth = {r["doc_id"]: r["lang"] for r in table(spark, small, "documents").collect()}
    rows = [r for r in QUERIES["op1_language_id"](spark, small).collect()]
    assert len(rows) == len(truth)
    assert all(r["held_out"] == is_held_out(r["doc_id"]) for r in rows)
    tested = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(tested) >= 0.9 * len(tested)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_mixtures_choose_their_languages(spark):
    words = {"xx": "tawo tawi wota".split(), "yy": "zempa pazem mapze".split(), "zz": "gunrik rikgun nukgir".split()}
    rng = random.Random(0)
    make = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    docs = spark.createDataFrame(
        [(i, make(lang, 60), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 20)], "doc_id long, text string, lang string"
    )
    found = language_id.train(docs)
    assert found.languages == ["xx", "yy", "zz"]
    texts = [make("xx", 90) + " " + make("yy", 30), make("zz", 50), "", "12 34", None]
    names, scores, sets = found.predict(texts)
    assert names == ["xx", "zz", "und", "und", "und"]
    assert sets[:2] == [["xx", "yy"], ["zz"]]
    assert abs(scores[0] - 0.75) < 0.05 and scores[1] > 0.99 and scores[2:] == [0, 0, 0]


def test_language_odd_rows(odd_docs, no_docs):
    rows = language_id.identify_languages(odd_docs).collect()
    assert len(rows) == 10
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (2, 3, 4, 5))
    assert by_id[None]["held_out"] is False
    assert language_id.identify_languages(no_docs).count() == 0


def brute_rules(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_rules_by_brute_force(spark, small):
    texts = [r["text"] for r in table(spark, small, "documents").select("text").collect()]
    rng = random.Random(2)
    texts += [" ".join(rng.choices("ab", k=rng.randint(0, 60))) for _ in range(200)]
    texts += [None, "", "a\na\n\n b\n b\na", "one two three \x0b four", prose(3, 4000) + " " + prose(3, 4000)]
    for t in texts:
        assert quality_rules.count_rules(t) == brute_rules(t)


def test_quality_query(spark, small):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, small, "labels").collect()}
    rows = QUERIES["op8_quality_rules"](spark, small).collect()
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in rows)
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    known = [(labels[r["doc_id"]], r) for r in rows if r["doc_id"] in labels]
    assert sum(r["kept"] for y, r in known if y == 1 and not r["base_failed"]) >= 0.97 * sum(
        not r["base_failed"] for y, r in known if y == 1
    )
    assert sum(r["kept"] for y, r in known if y == 0) <= 0.1 * sum(y == 0 for y, _ in known)


def test_quality_odd_rows(odd_docs, no_docs, odd_labels, no_labels):
    for labels in (odd_labels, no_labels):
        rows = quality_rules.judge_quality(odd_docs, labels).collect()
        assert len(rows) == 10
        assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, 4, 5))
        kept = quality_rules.keep_quality(odd_docs, labels)
        assert kept.columns == odd_docs.columns
    assert quality_rules.judge_quality(no_docs, no_labels).count() == 0


def toxic_corpus(n=400):
    rng = random.Random(9)
    docs = []
    for i in range(n):
        words = prose(i, 120).split()
        if i % 4 == 0:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(["grumblewort", "snarlbeast", "foulgrime"]))
        docs.append((" ".join(words), int(i % 4 == 0)))
    return docs


def test_toxicity_separates_held_out_rows():
    docs = toxic_corpus()
    found = toxicity.fit(docs[:300], {0: 225, 1: 75})
    scores = found.scores([t for t, _ in docs[300:]])
    assert all((s >= 0.5) == (y == 1) for s, (_, y) in zip(scores, docs[300:]))


def insulted(insults, n=4000):
    """Documents of which every fourth is toxic by words that ``insults(i, rng)`` gives."""
    docs, rng = [], random.Random(9)
    for i in range(n):
        words = prose(i, 120).split()
        if i % 4 == 0:
            pool = insults(i, rng)
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(pool))
        docs.append((" ".join(words), int(i % 4 == 0)))
    return docs


RARE = ["".join(random.Random(s).choices("aeiouyrwzxbcdfg", k=9)) for s in range(400)]


@pytest.mark.parametrize(
    "insults",
    [
        lambda i, rng: RARE,  # each in about 1.5 % of the toxic documents
        lambda i, rng: ["zug", "fej", "wyx"],
        lambda i, rng: ["hexgrind", "wurmfrass"] if i % 320 == 0 else ["grumblewort", "snarlbeast"],  # 1.25 %
    ],
    ids=["many rare", "short", "rare language"],
)
def test_insults_need_no_share_of_the_toxic_rows(insults):
    docs = insulted(insults)
    train = docs[:3000]
    found = toxicity.fit(train, {0: 2250, 1: 750})
    flagged = [s >= 0.5 for s in found.scores([t for t, _ in docs[3000:]])]
    truth = [y == 1 for _, y in docs[3000:]]
    assert sum(f and y for f, y in zip(flagged, truth)) >= 0.98 * sum(truth)
    assert sum(f and not y for f, y in zip(flagged, truth)) <= 0.01 * len(truth)
    assert all(f for f, i in zip(flagged, range(3000, 4000)) if i % 320 == 0)


def test_toxicity_query(spark, small):
    rows = QUERIES["op6_toxicity"](spark, small).collect()
    assert len(rows) == table(spark, small, "documents").count()
    assert all(r["held_out"] == is_held_out(r["doc_id"]) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_toxicity_odd_rows(odd_docs, no_docs, odd_labels, no_labels):
    for labels in (odd_labels, no_labels):
        assert toxicity.score_toxicity(odd_docs, labels).where("score is not null").count() == 10
        assert toxicity.drop_toxic(odd_docs, labels).columns == odd_docs.columns
    assert toxicity.score_toxicity(no_docs, no_labels).count() == 0
