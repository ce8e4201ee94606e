from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from verbarium.llm import prefix_trie
from verbarium.llm.prefix_trie import running, trie

from .conftest import multiset

COLUMNS = "conv_id long, turn long, role string, text string, depth int, k1 string, words string, place string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y", "z") for r in rows], COLUMNS)


def brute(rows) -> list[tuple]:
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        block = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(own.get(block, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)

    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        cost = (len(convs) - 1) * len(node[-1][1].split()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += cost
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(whole[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), leaves[node], saved[node], digest))
    return out


def check(df):
    assert multiset(trie(df).select(NAMES).collect()) == multiset(brute(df.collect()))


def random_rows(seed: int, convs: int, longest: int):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        turns = range(rng.randint(1, longest))
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a", "", None, "c\td  e"])) for t in turns]
    rng.shuffle(rows)
    return rows


def test_against_plain_python(spark):
    check(frame(spark, random_rows(1, 150, 6)))


@pytest.mark.parametrize("band", [2, 4])
def test_several_rounds_of_bands(spark, monkeypatch, band):
    monkeypatch.setattr(prefix_trie, "BAND", band)
    check(frame(spark, random_rows(band, 60, 20)))


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "no conversation"),
        (1, None, None, None),
        (1, 2, "user", "the same turn twice"),
        (1, 2, "user", "the same turn twice"),
        (1, 2, "assistant", "tie"),
        (1, None, "user", "null turns come first"),
        (20, 1, "user", "word " * 3000),
        (-3, 1, "user", "below zero"),
        (-3, 1, "user", "below zero é"),
        (-23, 5, "user", "x"),
        (21, 3, "user", "one turn"),
        (22, 3, "user", "one turn"),
        (45, 3, "user", "one turn"),  # its block does not exist
        (46, 1, "user", "one turn"),
        (47, 1, "user", "one turn"),
        (48, 9, "", ""),
    ]
    check(frame(spark, rows))


def test_empty_table(spark):
    assert trie(frame(spark, [])).collect() == []


def test_one_long_conversation_and_many_copies(spark):
    """A conversation of many turns fills several partitions; a third of the others are equal."""
    rows = [(40, t, "user", f"t{t % 7}") for t in range(1500)]
    rows += [(60 + c, t, "user", f"t{t}") for c in range(200) for t in range(4)]
    df = frame(spark, rows)
    placed = running(df.select("conv_id", "turn"), ["turn"], [], "test-running")
    assert placed.select("place").where("conv_id = 40").distinct().count() == 1500
    check(df)


def test_running_values_over_partitions(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.getrandbits(63) - (1 << 62)) for c, n in ((1, 900), (2, 1), (3, 700), (9, 5)) for t in range(n)]
    expected = []
    for c, t, _ in rows:
        x = 0
        for v in [r[2] for r in rows if r[0] == c and r[1] <= t]:
            x ^= v
        expected.append((c, x, t + 1))
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = running(spark.createDataFrame(rows, "conv_id long, t long, x long"), ["t"], ["x"], "test-xor")
        assert multiset(found.collect()) == multiset(expected)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_digest_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    check(frame(spark, [(c, 1, "user", "same") for c in range(100)]))
