"""Mixing and perspectives: properties beside the SQL twins of test_pages."""

import random
import re

import pytest

from tokengrove.llm import mixing, perspectives
from tokengrove.llm.base import WORD
from tokengrove.llm.queries import QUERIES
from .conftest import prose


def fill(sizes, weights):
    """Reshare until no target is above its cap."""
    budget, caps = sum(sizes), [3 * s for s in sizes]
    full = set()
    while True:
        open_w = sum(w for i, w in enumerate(weights) if i not in full)
        left = budget - sum(caps[i] for i in full)
        level = left / open_w if open_w else 0
        new = {i for i in range(len(sizes)) if i not in full and weights[i] * level > caps[i]}
        if not new:
            return [caps[i] if i in full else weights[i] * level for i in range(len(sizes))]
        full |= new


@pytest.mark.parametrize("seed", range(4))
def test_targets_by_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 5, 100, 3000, 90_000]) for _ in range(9)]
    names = [None, *[f"s{i}" for i in range(8)]]
    frame = spark.createDataFrame(list(zip(names, sizes)), "_source string, source_size long")
    found = {r["_source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    order = sorted(range(9), key=lambda i: (names[i] is None, names[i] or ""))
    wanted = fill([sizes[i] for i in order], [(5, 2, 1)[k % 3] for k in range(9)])
    assert [found[names[i]] for i in order] == pytest.approx(wanted)


def corpus(spark):
    rng = random.Random(3)
    rows = [(i, prose(i, rng.randint(5, 200)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_meets_its_targets_and_reruns_agree(spark):
    docs = corpus(spark)
    first = sorted(tuple(r) for r in mixing.mix_sources(docs).collect())
    assert first == sorted(tuple(r) for r in mixing.mix_sources(docs.repartition(7)).collect())
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    taken, target = {}, {}
    for doc_id, size, source_size, aim, words in first:
        s = sources[doc_id]
        assert size == len(re.findall(WORD, texts[doc_id])) and words % size == 0 and words <= 3 * size
        taken[s] = taken.get(s, 0) + words
        target[s] = aim
    assert all(abs(taken[s] - target[s]) <= 100 for s in taken)


def test_taken_rows_are_the_mix(spark):
    docs = corpus(spark).selectExpr("*", "1 AS size", "2 AS _key", "3 AS _copy")
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_sources(docs).collect() if r["taken"]}
    rows = mixing.take_mix(docs)
    assert rows.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert counts == taken


def test_heavier_documents_come_earlier(spark):
    frame = spark.range(4000).selectExpr("id", "IF(id % 2 = 0, 4.0, 1.0) AS w")
    keyed = frame.withColumn("k", mixing.sampling_key(frame["w"], frame["id"].cast("string")))
    firsts = [r["w"] for r in keyed.orderBy("k").limit(500).collect()]
    assert 0.74 <= firsts.count(4.0) / 500 <= 0.86  # 4 : 1 odds


def test_mix_odd_rows(odd_docs, no_docs):
    rows = mixing.mix_sources(odd_docs).collect()
    assert len(rows) == 10
    assert all(r["taken"] == 0 for r in rows if r["doc_id"] in (2, 3, 4))
    assert mixing.take_mix(odd_docs).columns == odd_docs.columns
    assert mixing.mix_sources(no_docs).count() == 0 and mixing.take_mix(no_docs).count() == 0


TURNS = [
    (1, 1, "ann", "hi all"), (1, 2, "bob", "hé 😀"), (1, 3, "ann", None), (1, 0, "system", "be kind"), (1, None, None, "who?"),
    (1, 2, "bob", "hé 😀"), (2, 0, "system", "alone"), (None, 1, "cat", ""), (3, 1, "ann", "x"), (3, 1, "bob", "x"),
]


def rendered(turns, who):
    text, mask = "", []
    for _, _, role, said in sorted(turns, key=lambda t: (t[1] is None, t[1] or 0, t[2] or "unknown", t[3] or "")):
        role, said = role or "unknown", said or ""
        head = "assistant" if role == who else "system" if role == "system" else f"user name={role}"
        text += f"<|im_start|>{head}\n"
        if role == who:
            mask.append((len(text), len(text) + len(said) + len("<|im_end|>")))
        text += f"{said}<|im_end|>\n"
    return text, mask


@pytest.mark.parametrize("part_bytes", [1 << 20, 40, 1])
def test_perspectives_by_brute_force(spark, part_bytes):
    frame = spark.createDataFrame([(*t, "x", 1) for t in TURNS], "conv_id long, turn long, role string, text string, participant string, part int")
    found = {}
    for r in sorted(perspectives.rotate(frame, part_bytes=part_bytes).collect(), key=lambda r: r["part"]):
        text, mask = found.get((r["conv_id"], r["participant"]), ("", []))
        mask = mask + [(m["start"] + len(text), m["end"] + len(text)) for m in r["mask"]]
        found[r["conv_id"], r["participant"]] = (text + r["text"], mask)
    wanted = {}
    for conv in {t[0] for t in TURNS}:
        turns = [t for t in TURNS if t[0] == conv]
        for who in {t[2] or "unknown" for t in turns} - {"system"}:
            wanted[conv, who] = rendered(turns, who)
    assert found == wanted
    assert perspectives.rotate(frame.limit(0)).count() == 0


def test_perspectives_use_no_python(spark, small):
    plan = QUERIES["op10_perspectives"](spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
