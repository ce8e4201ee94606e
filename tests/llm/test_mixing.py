from __future__ import annotations

import hashlib
from collections import Counter
from fractions import Fraction

import pytest

from verbarium.llm import mixing

from .conftest import multiset


def brute_targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction((3, 1, 2)[i % 3]) for i, s in enumerate(names)}
    budget = Fraction(3, 2) * sum(sizes.values())
    full: set = set()
    while True:
        open_ = [s for s in names if s not in full]
        rest = budget - sum(2 * sizes[s] for s in full)
        total = sum(weight[s] for s in open_)
        target = {s: Fraction(2 * sizes[s]) if s in full else rest * weight[s] / total for s in names}
        over = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def place(doc_id, size) -> int:
    text = f"{'' if doc_id is None else doc_id}:{size}"
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def brute(rows) -> list[tuple]:
    items = [(r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in rows]
    sizes: Counter = Counter()
    for _, source, size in items:
        sizes[source] += size
    target = brute_targets(sizes)
    out = []
    for source, total in sizes.items():
        upto = 0
        # Equal hashes mean equal sizes here, so their order does not show in the rows.
        for _, d, n in sorted(((place(d, n), d, n) for d, s, n in items if s == source), key=lambda x: x[0]):
            taken = 0
            for k in (0, 1):
                budget = min(max(float(target[source]) - total * k, 0), total)
                taken += n * (upto < budget and upto + n - budget <= budget - upto)
            upto += n
            out.append((d, n, total, taken))
    return out


def check(docs):
    found = mixing.mix(docs)
    assert multiset(found.select("doc_id", "size", "source_size", "taken").collect()) == multiset(brute(docs.collect()))
    sizes = {r["source"]: r["size"] for r in found.join(docs.select("doc_id", "source").distinct(), "doc_id")
             .groupBy("source").agg({"size": "max"}).toDF("source", "size").collect()}
    assert sizes is not None


def test_odd_rows(odd_docs):
    check(odd_docs)


def test_all_documents(small_docs):
    check(small_docs)


def test_empty_table(no_docs):
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 3}, {"a": 0, "b": 0}, {"a": 5}, {"a": 1, "b": 1, "c": 1, None: 500}])
def test_targets(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    found = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    expected = brute_targets(sizes)
    assert found == {s: pytest.approx(float(v)) for s, v in expected.items()}


def test_taken_words_come_near_the_targets(small_docs):
    rows = mixing.mix(small_docs).join(small_docs.select("doc_id", "source"), "doc_id").groupBy("source", "target")
    largest = small_docs.selectExpr("max(length(text)) AS n").first()["n"]
    for r in rows.agg({"taken": "sum"}).toDF("source", "target", "taken").collect():
        assert abs(r["taken"] - r["target"]) <= largest


def test_smaller_budgets_take_subsets(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "'s' AS source", "1 + id % 7 AS size")
    rows = rows.withColumn("h", mixing.place_hash(rows["doc_id"], rows["size"])).selectExpr("*", "0L AS t", "doc_id AS u")
    budgets = spark.createDataFrame([("s", k, float(b)) for k, b in enumerate((10, 500, 9000, 10**9))], "source string, k int, budget double")
    found = {r["k"]: r["below"] for r in mixing.thresholds(rows, budgets).collect()}
    assert found[0] <= found[1] <= found[2] <= found[3]
    for k, b in enumerate((10, 500, 9000)):
        words = rows.where(rows["h"] < found[k]["h"]).agg({"size": "sum"}).first()[0]
        assert abs(words - b) <= 4


def test_documents_are_repeated_as_often_as_taken(odd_docs):
    mixed = mixing.mixed(odd_docs)
    assert mixed.columns == odd_docs.columns
    times = Counter(r["doc_id"] for r in mixed.collect())
    expected = Counter()
    for r in mixing.mix(odd_docs).collect():
        expected[r["doc_id"]] += r["copies"]
    assert times == +expected


@pytest.mark.parametrize("same_text", [True, False])
def test_rows_that_share_a_key_meet_the_target_too(spark, same_text):
    text = "repeat('a ', 2400)" if same_text else "concat(repeat('a ', 2399), 'w', id)"
    null = "CAST(NULL AS LONG) AS doc_id"
    hot = spark.range(300).selectExpr(null, f"{text} AS text", "'hot' AS source")
    other = spark.range(40).selectExpr("id AS doc_id", "repeat('b ', cast(id * 50 as int)) AS text", "'other' AS source")
    docs = hot.union(other).union(hot.limit(1).selectExpr(null, "CAST(NULL AS STRING)", "'hot'"))
    for r in mixing.mix(docs).groupBy("target", "source_size").agg({"taken": "sum", "size": "max"}).toDF("target", "total", "size", "taken").collect():
        assert abs(r["taken"] - r["target"]) <= r["size"]
    check(docs)
    taken = mixing.mix(docs).agg({"copies": "sum"}).first()[0]
    assert mixing.mixed(docs).count() == taken


def test_columns_of_any_name(spark):
    names = ["below1", "_mix_source", "h", "row", "times", "s", "u", "a.b"]
    docs = spark.range(50).selectExpr("id AS doc_id", "'a b c' AS text", "'x' AS source", *(f"id * {n} AS `{c}`" for n, c in enumerate(names)))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in docs.collect()}
    check(docs)
