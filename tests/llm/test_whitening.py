from __future__ import annotations

import math

import numpy as np
import pytest

from verbarium.llm import whitening
from verbarium.llm.whitening import whiten

COLUMNS = "vec_id long, embedding array<float>, label int, id long, n long, row string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 7, 7, "x", "y") for i, v in rows], COLUMNS)


def brute(rows, components=32):
    """vec_id, deviation and whitened values, the shares, by numpy alone."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(column) for column in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    values = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    e, axes = np.linalg.eigh(values.T @ values / n)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(components, len(sums))
    return [i for i, _ in kept], deviation, values @ axes[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check(spark, rows):
    found = whiten(frame(spark, rows)).collect()
    ids, deviation, whitened, shares = brute(rows)
    k = len(shares)
    assert len(found) == len(ids) * k and {r["n"] for r in found} == {len(ids)}
    assert max(r["identity_error"] for r in found) < 1e-9
    ours = {(r["vec_id"], r["component"]): r for r in found}
    table = np.array([[ours[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    signs = np.sign((table * whitened).sum(0))
    assert np.abs(table - whitened * signs).max() < 1e-6
    for i, d in zip(ids, deviation, strict=True):
        for c in range(k):
            assert ours[i, c + 1]["deviation"] == d
            assert ours[i, c + 1]["explained"] == pytest.approx(shares[c], rel=1e-9)
    assert np.abs(table.T @ table / len(ids) - np.eye(k)).max() < 1e-6


def cloud(n, dims, seed=0):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims)) + rng.normal(size=dims) * 5
    return [(i, row.tolist()) for i, row in enumerate(mixed)]


def test_against_numpy(spark):
    check(spark, cloud(500, 6))


def test_many_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 8)
    monkeypatch.setattr(whitening, "GROUP", 3)
    check(spark, cloud(301, 20))  # 38 row blocks in 13 groups, 3 block columns


def test_vectors_left_out(spark):
    odd = [(900, None), (901, [1.0, None, 2.0]), (902, [math.nan, 0.0, 0.0]), (903, [math.inf, 0.0, 0.0]), (904, [-math.inf, 0.0, 0.0])]
    check(spark, odd + cloud(40, 3))
    ragged = [(905, []), (906, [1.0]), (907, [1.0, 2.0, 3.0, 4.0])]
    found = whiten(frame(spark, ragged + cloud(40, 3))).collect()
    assert {r["vec_id"] for r in found} == set(range(40)) and {r["n"] for r in found} == {40}


def test_repeated_and_null_ids(spark):
    rows = cloud(30, 2) + [(3, [1.0, 2.0]), (3, [1.0, 2.0]), (None, [1.0, 2.0])]
    found = whiten(frame(spark, rows)).collect()
    assert len(found) == 33 * 2 and sum(r["vec_id"] is None for r in found) == 2
    assert sum(r["vec_id"] == 3 for r in found) == 6


def test_no_variance(spark):
    """Three vectors of five dimensions span two; equal vectors span none."""
    found = whiten(frame(spark, cloud(3, 5))).collect()
    assert len(found) == 15
    assert {r["component"] for r in found if r["whitened"] is not None} == {1, 2}
    assert sum(r["explained"] for r in found) == pytest.approx(3.0)
    assert max(r["identity_error"] for r in found) < 1e-9
    found = whiten(frame(spark, [(i, [0.5, 0.25]) for i in range(4)])).collect()
    assert len(found) == 8 and {(r["whitened"], r["explained"], r["deviation"]) for r in found} == {(None, 0.0, 0)}


def test_huge_entries(spark):
    """Beyond what a long holds: sums stay exact, and a deviation that does not fit is null."""
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1e15, 3.0]), (4, [0.0, -4.0])]
    found = whiten(frame(spark, rows)).collect()
    assert len(found) == 8 and {r["deviation"] for r in found} == {None}


def test_empty_table(spark):
    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, None)])).collect() == []


def test_given_table(spark):
    import os

    from verbarium.llm.queries import op13_whitening

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    given = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    check(spark, [(r["vec_id"], r["embedding"]) for r in given])
    assert op13_whitening(spark, folder).count() == 32 * len(given)
