from __future__ import annotations

import zlib

import numpy as np
import pytest

from verbarium.llm import quality_net

FOLDER = "/root/testdata/sf0.1"


def labels_of(spark, docs):
    rows = [(r["doc_id"], int(r["doc_id"] % 2), 0) for r in docs.select("doc_id").distinct().collect() if r["doc_id"] is not None]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_odd_rows(spark, odd_docs):
    rows = quality_net.classify(odd_docs, labels_of(spark, odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        text = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(text.encode()) % 5 == 0)


def test_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_net.classify(no_docs, none).count() == 0
    assert quality_net.classify(odd_docs, none).count() == odd_docs.count()


def test_labels_that_are_null_or_contradict_are_left_out(spark):
    docs = spark.range(100).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(100).selectExpr("id AS doc_id", "CASE WHEN id < 50 THEN NULL ELSE 1 END AS quality")
    labels = labels.union(spark.range(50, 70).selectExpr("id AS doc_id", "0 AS quality"))
    texts, quality = quality_net.sample(docs, labels)
    expected = [i for i in range(70, 100) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(texts) == sorted(f"text {i}".encode() for i in expected) and set(quality) == {1}
    assert len(quality_net.sample(docs, labels, documents=5)[0]) == 5


def test_the_whole_text_counts():
    net = quality_net.start_network(3)
    rng = np.random.default_rng(1)
    text = rng.integers(0, 256, 200_001, np.uint8)
    best, where, mean = net.respond(text.tobytes())
    response = np.tanh(net.chunks(text) @ net.filters + net.bias)
    assert np.allclose(best, response.max(0), atol=1e-6)
    assert np.allclose(response[where, np.arange(quality_net.FILTERS)], best, atol=1e-6)
    assert np.allclose(mean, response.mean(0), atol=1e-4)


@pytest.mark.parametrize("size", [0, 1, 15, 16, 17, 20, 21, quality_net.BLOCK + 1])
def test_every_byte_is_in_a_chunk(size):
    net = quality_net.start_network()
    rows = net.chunks(np.ones(size, np.uint8))
    reached = (len(rows) - 1) * quality_net.STRIDE + quality_net.WIDTH
    assert reached >= size and (size <= quality_net.WIDTH or reached < size + quality_net.STRIDE)
    assert 0 <= net.score(b"x" * size) <= 1


def test_held_out_accuracy(spark):
    import os

    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    found = quality_net.classify(docs, labels, documents=1500).join(labels, "doc_id").where("held_out").toPandas()
    good = found["quality"] == 1
    assert (found["predicted"] == found["quality"]).mean() > 0.95
    assert (found["predicted"][good] == 1).mean() > 0.98
