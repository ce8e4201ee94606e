from __future__ import annotations

import hashlib
import random
from collections import Counter

from verbarium.llm import superkmers

from .conftest import multiset


def brute(rows) -> list[tuple]:
    texts = [(r["text"] or "").encode().split() for r in rows]
    total = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    out = []
    for r, w in zip(rows, texts, strict=True):
        gone = {j for i in range(len(w) - 34) if total[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r["doc_id"], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def check(docs, **limits):
    assert multiset(superkmers.remove_repeats(docs, **limits).collect()) == multiset(brute(docs.collect()))


def test_odd_rows(odd_docs):
    check(odd_docs)


def test_all_documents(small_docs):
    check(small_docs)


def test_hot_buckets(small_docs):
    check(small_docs, hot_texts=1)


def test_empty_table(no_docs):
    assert superkmers.remove_repeats(no_docs).count() == 0


def test_periods_and_shared_passages(spark):
    rng = random.Random(1)
    word = lambda n: [f"v{rng.randint(0, n)}" for _ in range(90)]
    common = word(10**6)
    rows = [["a"] * 100, ["a"] * 34, ["a"] * 36, ["a", "b"] * 40, word(3), common, word(10**6) + common[:35], common[1:60] + word(10**6),
            common[:34] + ["z"], word(10**6) + common[20:56] * 2]
    docs = spark.createDataFrame([(i, " \n".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    check(docs)
    check(docs, hot_texts=0)


def test_equal_windows_never_share_a_minimiser_place():
    rng = random.Random(2)
    for alphabet in (1, 2, 3, 50):
        words = [b"%d" % rng.randrange(alphabet) for _ in range(300)]
        starts, ends, _ = superkmers.minimisers(words)
        assert starts[0] == 0 and ends[-1] == len(words) - 34
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            inside = [tuple(words[i : i + 35]) for i in range(s, e)]
            assert len(set(inside)) == len(inside)
