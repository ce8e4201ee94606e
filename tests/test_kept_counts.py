from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from tests.test_import import BAD, LIEP, LOOP, LOPEN
from verbarium.operators import quality
from verbarium.plans import kept_counts
from verbarium.plans.importer import import_pages
from verbarium.plans.kept_counts import kept_violations, refresh_counts


def others(store, users=((1, "a", 1), (2, "b", 9), (2, "b", None), (None, None, 9))):
    rows = [(None if i is None else str(i), 2, name, target) for i, name, target in users]
    frame = store.spark.createDataFrame(rows, "id string, role_id int, name string, target_language_id int")
    return {"tenses": store.tenses, "roles": store.roles, "users": frame.withColumn("created_at", F.current_timestamp())}


def check(store):
    """The kept report equals the one that reads all tables."""
    rest = others(store)
    whole = quality.violations({"languages": store.languages, "words": store.words, "verb_forms": store.verb_forms, **rest})
    found = rows_of(kept_violations(store, rest))
    assert found == rows_of(whole)
    return found


def spoil(store, table: str, batch: int, change) -> None:
    """Write a batch's table anew with rows that break constraints, and count it again."""
    rows = store.read_batch(table, batch)
    path = f"{store.path}-spoiled-{table}-{batch}"
    change(rows).write.parquet(path)
    store.write(table, store.spark.read.parquet(path), batch)
    last = store._batches("batches").where(F.col("batch_id") == batch).select("last_word", "last_fact").first()
    store.finish(batch, *last)


def folders(store) -> set[str]:
    return {os.path.join(d, f) for d, _, names in os.walk(f"{store.path}/constraint_counts") for f in names if f.startswith("part-")}


def test_follows_the_imports(store, make_pages):
    assert refresh_counts(store) == []
    check(store)
    import_pages(store, make_pages((1, "lopen", LOPEN), (2, "loop", LOOP)))
    assert refresh_counts(store) == [0]
    check(store)
    first = folders(store)
    import_pages(store, make_pages((3, "liep", LIEP), (4, "zal", BAD)))
    import_pages(store, make_pages((5, "x", "no verb")))
    assert refresh_counts(store) == [1, 2]
    assert first < folders(store)
    found = check(store)
    assert {r[:3] for r in found} >= {("reference", "users", "target_language_id"), ("unique", "users", "id"), ("not null", "users", "id")}
    assert refresh_counts(store) == []


def test_a_batch_written_anew_counts_anew(store, make_pages):
    import_pages(store, make_pages((1, "lopen", LOPEN)))
    import_pages(store, make_pages((2, "loop", LOOP)))
    refresh_counts(store)
    import_pages(store, make_pages((3, "liep", LIEP)), batch=1)
    assert refresh_counts(store) == [1]
    check(store)


def forms(change: str):
    value, column = change.rsplit(" AS ", 1)
    return lambda rows: rows.withColumn(column, F.expr(value))


CHANGES = {
    "lost word": ("verb_forms", forms("word_id + 1000 AS word_id")),
    "lost tense": ("verb_forms", forms("7 AS tense_id")),
    "no number": ("verb_forms", forms("CAST(NULL AS INT) AS num")),
    "no id": ("verb_forms", forms("CAST(NULL AS LONG) AS id")),
    "id of another batch": ("verb_forms", forms("1L AS id")),
    "id of nothing": ("verb_forms", forms("id + 5000 AS id")),
    "rows twice": ("verb_forms", lambda rows: rows.union(rows)),
    "word of another batch": ("words", forms("'loop' AS word")),
    "word id of another batch": ("words", forms("1L AS id")),
    "no word": ("words", forms("CAST(NULL AS STRING) AS word")),
    "no rows": ("words", lambda rows: rows.limit(0)),
}


@pytest.mark.parametrize("name", CHANGES)
def test_violations_within_and_across_batches(store, make_pages, name):
    import_pages(store, make_pages((2, "loop", LOOP)))
    import_pages(store, make_pages((3, "liep", LIEP)))
    refresh_counts(store)
    before = check(store)
    spoil(store, CHANGES[name][0], 1, CHANGES[name][1])
    assert refresh_counts(store) == [1]
    after = check(store)
    assert (after == before) == (name == "id of nothing")


def test_a_refresh_that_breaks_off_is_repeated(store, make_pages, monkeypatch):
    import_pages(store, make_pages((1, "lopen", LOPEN)))
    refresh_counts(store)
    import_pages(store, make_pages((3, "liep", LIEP)))
    whole = kept_counts.constant_rows

    def fail(spark, rows, schema):
        if schema == kept_counts.COVERED:
            raise RuntimeError("lost")
        return whole(spark, rows, schema)

    monkeypatch.setattr(kept_counts, "constant_rows", fail)
    with pytest.raises(RuntimeError):
        refresh_counts(store)
    monkeypatch.undo()
    assert refresh_counts(store) == [1]
    check(store)


def test_the_report_reads_no_facts(store, make_pages):
    import_pages(store, make_pages((2, "loop", LOOP)))
    refresh_counts(store)
    files = kept_violations(store, others(store)).inputFiles()
    assert files and all("/constraint_counts/" in file for file in files)
