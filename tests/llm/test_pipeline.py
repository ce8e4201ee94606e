from __future__ import annotations

import os
from collections import Counter

import pytest

import corpus_pipeline
from tools import compare
from verbarium.llm import mixing, queries, rules, secrets, simhash
from verbarium.llm.common import staged

from . import test_mixing, test_packing, test_rules, test_simhash

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF_DIR), name.replace(" ", "-"))
        assert docs.columns == odd_docs.columns
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {"doc_id", "sequence_id", "offset"} <= set(packed.columns)


def test_empty_table(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() == 0


def test_pipeline_equals_its_parts_by_brute_force(spark, small_docs):
    """Each stage against plain Python on what the stage before it kept."""
    rows = small_docs.collect()
    judged = {r["doc_id"]: r["kept"] for r in rules.quality(small_docs).collect()}
    for r in rows:
        assert not (judged[r["doc_id"]] and test_rules.counts(r["text"])[-1])
    good = staged(corpus_pipeline.quality(spark, small_docs, SF_DIR), "t")
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(d for d, kept in judged.items() if kept)

    single = staged(corpus_pipeline.near_dedup(spark, good, SF_DIR), "t")
    expected = {c for _, _, c in test_simhash.brute(good.collect())}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(expected)

    clean = staged(corpus_pipeline.secret_scan(spark, single, SF_DIR), "t")
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        spans = secrets.base_spans(before[r["doc_id"]].encode())
        assert bool(spans) <= (r["text"] != before[r["doc_id"]])
        assert not secrets.base_spans(r["text"].encode())

    mixed = staged(corpus_pipeline.mix(spark, clean, SF_DIR), "t")
    taken = Counter()
    for d, n, _, words in test_mixing.brute(clean.collect()):
        taken[d] = words // n if n else 0
    assert Counter(r["doc_id"] for r in mixed.collect()) == +taken

    test_packing.check(mixed, test_packing.Tokenizer.from_file(queries.tokenizer_path()))


def test_near_duplicates_stay_once(spark, small_docs):
    once = simhash.keep_one(small_docs)
    assert simhash.keep_one(once).count() == once.count()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    same, note = compare.compare(spark, compare.connect(SF_DIR), SF_DIR, name)
    assert same, note


def test_mix_is_stable(small_docs):
    assert sorted(map(tuple, mixing.mix(small_docs).collect())) == sorted(map(tuple, mixing.mix(small_docs).collect()))
