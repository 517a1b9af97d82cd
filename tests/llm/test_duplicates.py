"""Near duplicates and components against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tokengrove.llm import embedding_dedup, weighted_minhash as wm
from tokengrove.llm.components import connected_components
from tokengrove.llm.queries import QUERIES
from .conftest import prose


def roots(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "loops"])
def test_components(spark, shape):
    rng = random.Random(4)
    order = rng.sample(range(200), 200)
    edges = {
        "chain": list(zip(order, order[1:])),
        "star": [(order[0], x) for x in order[1:]],
        "random": [tuple(rng.sample(range(200), 2)) for _ in range(120)],
        "loops": [(x, x) for x in range(5)],
    }[shape]
    found = {r["v"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    wanted = roots(range(200), edges)
    assert {n: found.get(n, n) for n in range(200)} == wanted


def idf_of(documents, df):
    return 1 - wm.DAMP * (1 - min(1.0, math.log1p(documents / df) / math.log1p(1 / wm.COMMON)))


def brute_classes(rows):
    """Exact classes by TF-IDF weighted Jaccard of five-word shingles."""

    def shingles(text):
        words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
        k = min(5, len(words))
        return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()

    rows = [(i, t) for i, t in rows if i is not None and t is not None]
    sets = [shingles(t) for _, t in rows]
    df = Counter(s for c in sets for s in c)
    n = len(rows)
    idf = {s: idf_of(n, df[s]) for s in df}
    total = [sum(k * idf[s] for s, k in c.items()) for c in sets]
    edges = []
    for i in range(n):
        for j in range(i):
            both = sum(min(k, sets[j][s]) * idf[s] for s, k in sets[i].items() if s in sets[j])
            near = both and both >= wm.THRESHOLD * (total[i] + total[j] - both)
            if near or rows[i][1] == rows[j][1]:
                edges.append((rows[i][0], rows[j][0]))
    return roots({i for i, _ in rows}, edges)


def families(count, size, words, changed):
    rng = random.Random(8)
    rows = []
    for f in range(count):
        base = prose(1000 + f, words).split()
        for _ in range(size):
            copy = base[:]
            for _ in range(changed):
                copy[rng.randrange(words)] = f"new{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_by_brute_force(spark):
    shared = prose(77, 60)
    rows = families(12, 8, 150, 2) + [(500 + i, prose(i, 25) + " " + shared) for i in range(40)]
    rows += [(600, rows[0][1]), (601, "one two"), (602, "one two"), (603, "one"), (604, "..."), (605, "...")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in wm.near_duplicates(docs).collect()}
    assert found == brute_classes(rows)


def test_blocks_settle_what_pivots_miss(spark, monkeypatch):
    # Neighbours on a chain are alike, its ends are not.
    words = prose(5, 260).split()
    rows = [(i, " ".join(words[3 * i : 3 * i + 120])) for i in range(40)]
    docs = spark.createDataFrame(random.Random(1).sample(rows, 40), "doc_id long, text string")
    monkeypatch.setattr(wm, "BLOCK", 8)
    found = {r["doc_id"]: r["class_id"] for r in wm.near_duplicates(docs).collect()}
    assert found == brute_classes(rows) == {i: 0 for i in range(40)}


def test_copies_in_a_large_group_stay_together(spark):
    rng = random.Random(2)
    base = prose(50, 160).split()
    copies = []
    for _ in range(120):  # a third of all rows, each with a word changed
        words = base[:]
        words[rng.randrange(160)] = f"other{rng.randrange(10**6)}"
        copies.append(" ".join(words))
    rows = list(enumerate([t for i, c in enumerate(copies) for t in (c, prose(2000 + i, 90), prose(5000 + i, 90))]))
    found = {r["doc_id"]: r["class_id"] for r in wm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_classes(rows)
    assert len({found[i] for i, _ in rows[::3]}) == 1


def test_common_shingles_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(wm, "SEGMENT", 3000)
    monkeypatch.setattr(wm, "ROUND", 100)
    line = prose(3, 9)
    texts = [prose(i, 60) + (" " + line) * (1 + i % 2) * (i % 3 == 0) for i in range(300)]
    docs = spark.createDataFrame([(t,) for t in texts], "_text string").repartition(3)
    weights = wm.common_shingles(spark, docs)
    counted = Counter()
    for t in texts:
        counted.update(set(wm.shingles([t])[0].tolist()))
    often = {h: n for h, n in counted.items() if n >= wm.COMMON * len(texts)}
    assert set(weights.hashes.tolist()) == set(often)
    assert np.allclose([idf_of(len(texts), often[h]) for h in weights.hashes.tolist()], weights.idf)


def test_samples_agree_as_often_as_texts_are_alike():
    weights = wm.Weights(np.zeros(0, np.uint64), np.zeros(0), 1000)
    sampler = wm.Sampler(weights)
    met, expected = [], []
    for i in range(150):
        a = prose(i, 200)
        words = a.split()
        for k in range(i % 7):
            words[(31 * k) % 200] = f"other{k}"
        b = " ".join(words)
        similar = wm.similarity(weights.features(a), weights.features(b))
        if similar >= wm.THRESHOLD:
            x, y = sampler.bands([a, b])
            met.append((x == y).mean())
            expected.append(similar**wm.ROWS)
    assert abs(np.mean(met) - np.mean(expected)) < 0.05


def test_duplicates_query(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = {r["doc_id"]: (r["class_id"], r["kept"]) for r in QUERIES["op2_weighted_minhash"](spark, small).collect()}
    assert found == {k: (c, k == c) for k, c in brute_classes(rows).items()}


def test_duplicates_odd_rows(odd_docs, no_docs):
    rows = wm.near_duplicates(odd_docs).collect()
    assert len(rows) == 10
    found = {r["doc_id"]: (r["class_id"], r["kept"]) for r in rows}
    assert found[7] == (1, False) and found[1] == (1, True) and found[None] == (None, True) and found[2] == (2, True)
    kept = wm.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8]
    assert wm.near_duplicates(no_docs).count() == 0


def brute_links(rows, threshold=0.9):
    good = {
        i: np.array(v, float)
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    edges = []
    ids = sorted(good)
    for a in ids:
        for b in ids:
            x, y = good[a], good[b]
            if a < b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                edges.append((a, b))
    links = Counter(i for e in edges for i in e)
    return {i: (links[i], c) for i, c in roots([i for i, _ in rows if i is not None], edges).items()}


def test_embedding_links_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((150, 24)))]
    centre = rng.standard_normal(24)
    rows += [(1000 + i, (centre + 0.08 * rng.standard_normal(24)).tolist()) for i in range(90)]
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link_vectors(frame).collect()}
    assert found == brute_links(rows)


def test_embedding_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0], 5, 0), (2, [2.0, 0.0], 5, 0), (3, None, 5, 0), (4, [0.0, 0.0], None, 0), (5, [1.0, None], 5, 0),
        (6, [float("nan"), 1.0], 5, 0), (7, [float("inf"), 1.0], 5, 0), (None, [1.0, 0.0], 5, 0), (8, [], 5, 0),
        (9, [1.0, 0.0, 0.0], 5, 0), (1, [1.0, 0.0], 5, 0), (10, [1e-300, 0.0], 5, 0),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")
    found = sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link_vectors(frame).collect() if True and r["vec_id"] is not None)
    assert found == [
        (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True),
        (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 2, 1, False),
    ]
    assert embedding_dedup.link_vectors(frame.limit(0)).count() == 0


def test_number_of_tables_reaches_the_recall():
    for n in (10, 10_000, 10**9):
        signs, tables = embedding_dedup.table_plan(n)
        meet = (1 - math.acos(0.9) / math.pi) ** signs
        assert 1 - (1 - meet) ** tables >= embedding_dedup.RECALL


def test_idf_is_whole_and_a_large_group_counts_once(spark):
    rng = random.Random(9)
    line = "a line that every other text of this corpus has"
    base = prose(70, 150).split()
    copies = []
    for _ in range(120):
        words = base[:]
        words[rng.randrange(150)] = f"own{rng.randrange(10**6)}"
        copies.append(" ".join(words))
    texts = copies + [prose(9000 + i, 60) + " " + line for i in range(240)]
    weights = wm.common_shingles(spark, spark.createDataFrame([(t,) for t in texts], "_text string").repartition(3))
    common, _ = wm.shingles([line])
    assert (weights.of(common) < 0.16).all()  # ln 2 / ln 101 = 0.15; it was 0.92
    shared, _ = wm.shingles([" ".join(base)])
    assert np.median(weights.of(shared)) > 0.9  # 120 of 360 would be 0.3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in wm.near_duplicates(docs).collect()}
    assert found == {i: 0 if i < 120 else i for i in range(360)}
