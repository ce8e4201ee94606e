from __future__ import annotations

import numpy as np

from verbarium.llm import embeddings

from .conftest import multiset
from .test_simhash import roots

SCHEMA = "vec_id long, embedding array<float>, label int, component_id long"


def brute(rows, cosine=0.93) -> list[tuple]:
    units = []
    for r in rows:
        v = embeddings.unit(r["embedding"]) if r["label"] is not None else None
        units.append(None if v is None else np.frombuffer(v))
    links = []
    for i, u in enumerate(units):
        for j in range(i):
            w = units[j]
            if u is not None and w is not None and rows[i]["label"] == rows[j]["label"] and len(u) == len(w) and float(u @ w) >= cosine:
                links.append((i, j))
    root = roots(len(rows), links)
    count = [0] * len(rows)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    least: dict[int, int] = {}
    for r, c in zip(rows, root, strict=True):
        if r["vec_id"] is not None:
            least[c] = min(least.get(c, r["vec_id"]), r["vec_id"])
    return [(r["vec_id"], n, least.get(c), r["vec_id"] == least.get(c)) for r, n, c in zip(rows, count, root, strict=True)]


def run(df, **options):
    return multiset(embeddings.near_duplicates(df, **options).collect())


def clusters(seed: int, n: int = 40, size: int = 8, dim: int = 16):
    """Groups around common centres, with cosines on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n):
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            v = centre + rng.standard_normal(dim) * rng.choice((0.0, 0.02, 0.05, 0.1))
            rows.append((len(rows), [float(x) for x in v * rng.choice((1, 3))], g % 3, 1))
    return rows


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1, 9), (2, [1.0, 0.01], 1, 9), (3, [2.0, 0.0], 1, 9), (3, [2.0, 0.0], 1, 9), (4, [1.0, 0.0], 2, 9),
        (5, None, 1, 9), (6, [], 1, 9), (7, [0.0, 0.0], 1, 9), (8, [nan, 1.0], 1, 9), (9, [inf, 1.0], 1, 9), (10, [None, 1.0], 1, 9),
        (11, [1.0, 0.0], None, 9), (None, [1.0, 0.0], 1, 9), (None, [0.0, 1.0], 1, 9), (12, [1.0], 1, 9), (13, [1e-30, 0.0], 1, 9),
        (14, [0.0, 1.0, 0.0], 1, 9), (15, [0.0, 1e30], 5, 9), (16, [0.0, 1e30], 5, 9), (17, [0.0, 1.0, 1e-3], 1, 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = [(*r[:3], r[3] or (r[0] is None and r[2] is None)) for r in brute(df.collect())]
    assert run(df) == multiset(expected)


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_leaf_is_brute_force(spark):
    df = spark.createDataFrame(clusters(1), SCHEMA)
    assert run(df) == multiset(brute(df.collect()))


def test_blocks_of_a_tight_leaf_count_every_pair_once(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(8)
    rows = [(i, [float(x) for x in centre + rng.standard_normal(8) * 0.05], 0, 1) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert run(df, leaf=10) == multiset(brute(df.collect()))


def test_recall_of_small_leaves(spark):
    df = spark.createDataFrame(clusters(3, n=120), SCHEMA)
    expected, found = brute(df.collect()), embeddings.near_duplicates(df, leaf=20).collect()
    links = {r[0]: r[1] for r in expected}
    got = {r["vec_id"]: r["n_links"] for r in found}
    assert all(got[k] <= links[k] for k in links)
    assert sum(got.values()) >= 0.97 * sum(links.values())


def test_recall_on_the_given_table(spark):
    import os

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        return
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    found = embeddings.near_duplicates(df).agg({"n_links": "sum"}).first()[0]
    pdf = df.toPandas()
    total = 0
    for _, part in pdf.groupby("label"):
        v = np.array(part["embedding"].tolist(), np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        total += int((v @ v.T >= 0.93).sum()) - len(part)
    assert 0.9 * total <= found <= total


def test_recall_in_a_dense_cloud(spark):
    """A label of 4,000 vectors with typical cosines around 0.9, and one with such a cloud in a third of its rows."""
    rng = np.random.default_rng(5)
    dim, n = 64, 4000
    centres = np.repeat(rng.standard_normal((1, dim)), n, 0)
    cloud = centres / np.linalg.norm(centres, axis=1, keepdims=True) + rng.standard_normal((n, dim)) * 0.33 / np.sqrt(dim)
    other = rng.standard_normal((n, dim))
    other[: n // 3] = cloud[: n // 3]
    rows = [(i, v.tolist(), i // n, 1) for i, v in enumerate(np.concatenate([cloud, other]))]
    found = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA), leaf=64).collect()}
    for label, part in enumerate((cloud, other)):
        v = np.array([np.frombuffer(embeddings.unit(x)) for x in np.float32(part).astype(float).tolist()])
        total = int((v @ v.T >= 0.93).sum()) - n
        assert 0.9 * total <= sum(found[label * n + i] for i in range(n)) <= total
