from __future__ import annotations

import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from verbarium.llm import simhash
from verbarium.llm.common import components

from .conftest import multiset


def brute_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [words[i : i + 4] for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n: int, links) -> list[int]:
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute(rows) -> list[tuple]:
    prints = [brute_fingerprint(r["text"]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = roots(len(rows), links)
    least: dict[int, int] = {}
    for r, c in zip(rows, root, strict=True):
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    return [(r["doc_id"], f"{p:016x}", least.get(c)) for r, p, c in zip(rows, prints, root, strict=True)]


def check(docs, limit=simhash.PAIR_LIMIT):
    found = simhash.near_duplicates(docs, limit).select("doc_id", "fingerprint", "component_id")
    assert multiset(found.collect()) == multiset(brute(docs.collect()))


def test_odd_rows(odd_docs):
    check(odd_docs)


def test_all_documents(small_docs):
    check(small_docs)


def test_hot_keys_lose_no_link(small_docs):
    check(small_docs, limit=1)


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0


def test_same_hash_as_spark(spark):
    text = "one two three four"
    own = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert own % 2**64 == xxhash.xxh64_intdigest(text, 42)


def neighbours(seed: int) -> list[int]:
    """Fingerprints in chains and clusters, with distances around the limit."""
    rng = random.Random(seed)
    found = []
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(12):
            found.append(x)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
    return found


def test_links_connect_what_pairs_connect(spark):
    for limit in (1, 4, 1000):
        prints = sorted(set(neighbours(limit)))
        signed = [p - (1 << 64) if p >> 63 else p for p in prints]
        df = spark.createDataFrame([(p,) for p in signed], "fp long")
        edges = simhash.fingerprint_links(df, limit)
        number = {p: i for i, p in enumerate(signed)}
        links = [(number[r["a"]], number[r["b"]]) for r in edges.collect()]
        mask = (1 << 64) - 1
        near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
        assert all((signed[i] ^ signed[j]) & mask for i, j in near)
        a, b = roots(len(prints), links), roots(len(prints), near)
        assert len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_chains_prune_only_far_pairs(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 8)):
            y ^= 1 << b
        pairs.append(tuple(v - (1 << 64) if v >> 63 else v for v in (x, y)))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a long, b long")
    left = df.select("i", "a", F.explode(simhash.chain_keys(F.col("a"))).alias("key"))
    right = df.select("i", "b", F.explode(simhash.chain_keys(F.col("b"))).alias("key"))
    met = left.join(right, ["i", "key"]).toPandas()
    difference = met["a"].to_numpy().view(np.uint64) ^ met["b"].to_numpy().view(np.uint64)
    held = simhash.chain_holds(difference, met["key"].to_numpy() >> 32)
    found, reached = set(met["i"][held]), set(met["i"])
    for i, (a, b) in enumerate(pairs):
        near = ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4
        assert not near or i in found
    assert len(found) < len(reached) < len(pairs)


def test_majority_over_blocks():
    hashes = np.random.default_rng(0).integers(0, 2**64, 70_000, dtype=np.uint64)
    bits = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))
    assert simhash.majority(hashes) == bits


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(500, 500)]
    links += [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(150)]
    rng.shuffle(links)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "test").collect()}
    root = roots(1500, links)
    nodes = {x for link in links for x in link}
    least: dict[int, int] = {}
    for x in sorted(nodes):
        least.setdefault(root[x], x)
    assert found == {x: least[root[x]] for x in nodes}


def test_one_of_each_group_stays(odd_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = odd_docs.collect()
    expected = brute(rows)
    groups = Counter()
    for row in brute(kept.collect()):
        groups[row[1]] += 1
    assert all(n == 1 for n in groups.values())
    component = {(r[1]): r[2] for r in expected}
    names = {component[p] for p in component}
    found = {r["doc_id"] for r in kept.collect()}
    assert found - {None} == names - {None}


def test_keep_one_loses_no_unrelated_text_of_a_repeated_id(spark):
    texts = ["one two three four five six seven", "lorem ipsum dolor sit amet elit sed", "red green blue white black pink grey"]
    rows = [(1, texts[0], "a", 0), (1, texts[1], "a", 1), (2, texts[2], "b", 2), (2, texts[2], "b", 2), (None, texts[0], None, 3), (None, "alone in its group of rows here", "c", 4)]
    rows += [(3, texts[1], "a", 5), (None, "twice here and without an id at all", "c", 6), (None, "twice here and without an id at all", None, 6)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, `r1` string, `n` int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    found = multiset(tuple(r)[:2] for r in kept.collect())
    lone = [rows[5][:2], rows[7][:2]]
    assert found == multiset([*(r[:2] for r in rows[:3]), *lone])
    assert set(map(tuple, kept.collect())) <= set(rows)


def test_keep_one_of_a_hot_row(spark):
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "if(id % 3 = 0, 'the same text in a third of rows', concat_ws(' ', sha2(cast(id as string), 256), id, md5(cast(id as string)), id * 7, hex(id), id * 13)) AS text")
    kept = simhash.keep_one(docs)
    assert kept.where("doc_id = 7 AND text LIKE 'the same%'").count() == 1
    assert kept.count() == simhash.near_duplicates(docs).select("component").distinct().count()
