"""The pipeline against its stages done by brute force."""

import hashlib
import struct
from collections import Counter

import pytest

import corpus_pipeline
from tokengrove.llm import mixing, quality_rules, toxicity, trie_bpe
from tokengrove.llm.base import table
from tokengrove.llm.queries import tokenizer_path
from .test_duplicates import brute_classes


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """Input and output of each stage, written and read as a runner does."""
    docs, out = table(spark, small, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name.replace(" ", "_"))
        stage(spark, docs, small).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    for before, after in stages[:-1]:
        assert after.schema.simpleString() == before.schema.simpleString()
        assert after.count() > 0.3 * before.count()


def test_rejected_documents_go(spark, small, stages):
    labels = table(spark, small, "labels")
    before, after = stages[0]
    kept = {r["doc_id"] for r in quality_rules.judge_quality(before, labels).collect() if r["kept"]}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(kept)
    before, after = stages[1]
    toxic = {r["doc_id"] for r in toxicity.score_toxicity(before, labels).collect() if r["predicted"]}
    assert {r["doc_id"] for r in after.collect()} == kept - toxic


def test_one_of_each_class_stays(stages):
    before, after = stages[2]
    classes = brute_classes([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(k for k, c in classes.items() if k == c)


def test_mix_and_encoding(stages):
    before, after = stages[3]
    copies = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_sources(before).collect() if r["taken"]}
    assert Counter(r["doc_id"] for r in after.collect()) == copies
    before, after = stages[4]
    model = trie_bpe.read_model(tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert after.count() == before.count()
    for r in after.collect():
        ids = model.encode_batch([texts[r["doc_id"]]])[0]
        assert r["n_tokens"] == len(struct.unpack(f"<{len(ids) // 4}I", ids))
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_is_the_stages(spark, small, stages):
    key = lambda r: (r["doc_id"], r["ids_sha256"])
    assert sorted(map(key, corpus_pipeline.run(spark, small).collect())) == sorted(map(key, stages[-1][1].collect()))
