from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from verbarium.llm import common, packing
from verbarium.llm.queries import tokenizer_path

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def check(docs, plain, run=packing.RUN):
    pieces = packing.pack(docs, PATH, run).collect()
    sequences = defaultdict(list)
    documents = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
        documents[p["doc_id"], p["doc_tokens"]].append(p)
    for rows in sequences.values():
        reached = 0
        for p in sorted(rows, key=lambda p: p["offset"]):
            assert p["offset"] == reached and p["length"] > 0
            reached += p["length"]
        assert reached <= packing.MAX
    # Exact round trip: each id of each row lies in one piece.
    expected = defaultdict(list)
    for r in docs.collect():
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        expected[r["doc_id"], len(ids)].append(np.array(ids, "<u4"))
    assert {k: len(v) * k[1] for k, v in expected.items()} == {k: sum(p["length"] for p in v) for k, v in documents.items()}
    for key, rows in documents.items():
        for p in rows:
            at = slice(p["start"], p["start"] + p["length"])
            assert p["ids_crc32"] in {zlib.crc32(ids[at].tobytes()) for ids in expected[key]}
    return pieces


def padding(pieces) -> float:
    length = defaultdict(int)
    for p in pieces:
        length[p["sequence_id"]] += p["length"]
    padded = sum(0 if n & (n - 1) == 0 else packing.MAX - n for n in length.values())
    return padded / sum(length.values())


def test_odd_rows(odd_docs, plain):
    check(odd_docs, plain)


def test_all_documents_with_little_padding(small_docs, plain):
    assert padding(check(small_docs, plain)) < 0.015


def test_short_runs(small_docs, plain):
    check(small_docs, plain, run=5000)


def test_empty_table(no_docs):
    assert packing.pack(no_docs, PATH).count() == 0


def test_reruns_agree(small_docs):
    first, second = (sorted(map(tuple, packing.pack(small_docs, PATH).collect())) for _ in range(2))
    assert first == second


def test_text_without_sentences(spark, plain):
    docs = spark.createDataFrame([(1, "word " * 20_000), (2, "x" * 9000), (3, "a. b. c.")], "doc_id long, text string")
    check(docs, plain)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from("aB's. \t\n\x1cÉ́İΣςß1!<|endoftext|>")), max_size=60))
def test_ids_by_word_equal_ids_of_the_text(text):
    own = packing.tokenizer_of(PATH).ids(text.encode(errors="ignore"))
    known = Tokenizer.from_file(PATH) if not hasattr(test_ids_by_word_equal_ids_of_the_text, "t") else test_ids_by_word_equal_ids_of_the_text.t
    test_ids_by_word_equal_ids_of_the_text.t = known
    assert own.tolist() == known.encode(text.encode(errors="ignore").decode(), add_special_tokens=False).ids


def test_cuts_are_the_cheapest():
    rng = random.Random(4)
    for _ in range(50):
        places = sorted(rng.sample(range(1, 14_000), 40)) + [14_100]
        places = sorted(set(places) | set(range(2000, 14_000, 2000)))
        penalties = [rng.choice((0, 4, 48)) for _ in places]
        best = {0: 0}
        for p, cost in zip(places, penalties, strict=True):
            best[p] = min(v + packing.MAX - (p - q) + cost for q, v in best.items() if p - q <= packing.MAX)
        ends = packing.best_cuts(places, penalties)
        price = dict(zip(places, penalties, strict=True))
        total = sum(packing.MAX - (b - a) + price[b] for a, b in zip([0, *ends], ends[:-1], strict=False))
        last = [v for q, v in best.items() if places[-1] - packing.MAX <= q < places[-1]]
        assert ends[-1] == places[-1] and total == min(last)


def test_tables_of_a_worker_are_dropped_by_other_operators(spark):
    """Idle workers do not hold the tokenizer's tables while other stages of a pipeline run."""
    common.make_importable(spark)
    docs = spark.createDataFrame([(n, f"word{n} again") for n in range(20)], "doc_id long, text string").coalesce(1)

    def held(rows):
        return {"doc_id": rows["doc_id"], "n": [len(common._tables)] * len(rows["doc_id"])}

    def tables(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(common._tables)], pa.int64())})

    packing.pack(docs, PATH).collect()
    assert {row["n"] for row in docs.select("doc_id").mapInArrow(tables, "n long").collect()} == {1}
    assert {row["n"] for row in common.map_rows(docs, held, "doc_id long, n long").collect()} == {0}
