from __future__ import annotations

import json
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.conftest import rows_of
from verbarium import schemas
from verbarium.operators import conjugation, results, words

ALL_SLOTS = ["First", "Second", "Third", "Plural"]


@pytest.fixture(scope="module")
def verb(spark):
    """A verb with two forms in some slots, one of them stored twice; 20 is its infinitive."""
    texts = {20: "varen", 21: "vaar", 22: "vaart", 23: "voer", 24: "voeren", 25: "vaarde", 26: "vare"}
    word_rows = spark.createDataFrame(list(texts.items()), schemas.WORDS)
    facts = [
        (30, 4, 24, 20, 2, None, 2),
        (31, 4, 25, 20, 2, 6, 1),
        (32, 4, 23, 20, 2, 14, 1),
        (33, 4, 22, 20, 1, 8, 1),
        (34, 4, 22, 20, 1, 4, 1),
        (35, 4, 21, 20, 1, 6, 1),
        (36, 4, 26, 20, 1, 2, 1),
        (37, 4, 20, 20, 1, None, 2),
        (38, 4, 20, 20, 1, None, 2),
    ]
    return spark.createDataFrame(facts, schemas.VERB_FORMS), word_rows


def nested(rows):
    return {
        row.Infinitive: {t: {s: list(row[t][s]) for s in ALL_SLOTS} for t in ("Present", "Past")}
        for row in rows
    }


COMPLETE = {
    "Present": {"First": ["vaar", "vare"], "Second": ["vaar", "vaart"], "Third": ["vaart"], "Plural": ["varen", "varen"]},
    "Past": {"First": ["vaarde", "voer"], "Second": ["vaarde", "voer"], "Third": ["voer"], "Plural": ["voeren"]},
}
BLANK = {t: {s: [] for s in ALL_SLOTS} for t in ("Present", "Past")}


def test_complete_verb_fills_all_slots(verb):
    for form in ["vare", "voeren", "varen"]:
        assert nested(conjugation.conjugation_table(*verb, form).collect()) == {"varen": COMPLETE}
    assert conjugation.conjugation_table(*verb, "fiets").isEmpty()


def test_long_rows_hold_the_same_forms(verb):
    rows = conjugation.conjugation_slots(*verb).collect()
    found = {t: {s: [] for s in ALL_SLOTS} for t in ("Present", "Past")}
    for row in rows:
        assert (row.inf_id, row.infinitive) == (20, "varen")
        found[row.tense][row.slot] += [row.form] * row.copies
    assert {t: {s: sorted(forms) for s, forms in slots.items()} for t, slots in found.items()} == COMPLETE
    assert len(rows) == 12


def test_a_hot_infinitive_has_one_whole_table(spark):
    n = 30_000
    texts = spark.range(n + 1).selectExpr("id", "concat('w', id) AS word")
    facts = spark.range(1, n + 1).selectExpr(
        "id", "1 AS lang_id", "id AS word_id", "0L AS inf_id", "1 AS tense_id", "CAST(NULL AS INT) AS person", "2 AS num"
    )
    (row,) = conjugation.conjugation_tables(facts.union(facts), texts).collect()
    assert row.Infinitive == "w0" and len(row.Present.Plural) == 2 * n
    slots = conjugation.conjugation_slots(facts.union(facts), texts)
    assert slots.count() == n and slots.filter("copies <> 2").isEmpty()


def test_json_of_a_table(verb):
    table = conjugation.conjugation_tables(*verb).drop("inf_id")
    (row,) = results.as_json(table).collect()
    assert json.loads(row.json) == {"Infinitive": "varen", **COMPLETE}
    assert list(json.loads(row.json)) == ["Infinitive", "Present", "Past"]


def test_json_of_users_has_the_documented_names(spark):
    from datetime import datetime

    row = ("a", 1, "ann", None, datetime(2020, 1, 2, 3, 4, 5))
    (found,) = results.as_json(results.documented_users(spark.createDataFrame([row], schemas.USERS))).collect()
    assert json.loads(found.json) == {
        "id": "a", "name": "ann", "role": 1, "target-language": None, "creation-tz": "2020-01-02T03:04:05Z",
    }


def test_flat_rows(verb):
    flat = conjugation.flat_tables(conjugation.conjugation_tables(*verb))
    assert rows_of(flat, "Infinitive", "label", "Present", "Past") == [
        ("varen", "1st person singular", "vaar, vare", "vaarde, voer"),
        ("varen", "2nd person singular", "vaar, vaart", "vaarde, voer"),
        ("varen", "3rd person singular", "vaart", "voer"),
        ("varen", "Plural", "varen, varen", "voeren"),
    ]


def test_lookups_get_a_table_or_a_blank_one(spark, verb):
    asked = spark.createDataFrame([(1, "vaar"), (2, "fiets"), (3, ""), (4, "voer"), (5, "vaar")], "n int, word string")
    found = conjugation.look_up_tables(asked, *verb).orderBy("n").collect()
    assert [(row.n, row.word, row.Infinitive) for row in found] == [
        (1, "vaar", "varen"),
        (2, "fiets", ""),
        (4, "voer", "varen"),
        (5, "vaar", "varen"),
    ]
    assert nested(found) == {"varen": COMPLETE, "": BLANK}


def test_missing_words(spark, verb):
    facts, texts = verb
    texts = texts.unionByName(spark.createDataFrame([(7, "zijn")], schemas.WORDS))
    asked = spark.createDataFrame([("vaar",), ("fiets",), ("",), ("zijn",)], "word string")
    assert rows_of(words.missing_words(asked, facts, texts)) == [
        ("fiets", "word fiets does not exist"),
        ("zijn", "word zijn does not exist"),
    ]


def test_forms_that_fill_no_slot_leave_a_blank_table(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b")], schemas.WORDS)
    facts = spark.createDataFrame(
        [(1, 1, 1, 2, 1, 0, 1), (2, 1, 1, 2, 1, None, 1), (3, 1, 1, 2, 1, 2, 3)], schemas.VERB_FORMS
    )
    assert nested(conjugation.conjugation_tables(facts, texts).collect()) == {"b": BLANK}
    assert conjugation.person_slots(facts).isEmpty()


def test_languages_can_be_kept_apart(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b")], schemas.WORDS)
    facts = spark.createDataFrame(
        [(1, 1, 1, 2, 1, None, 2), (2, 2, 2, 2, 1, None, 2)], schemas.VERB_FORMS
    )
    (mixed,) = conjugation.conjugation_tables(facts, texts).collect()
    assert mixed.Present.Plural == ["a", "b"]
    apart = conjugation.conjugation_tables(facts, texts, ["lang_id"]).collect()
    assert {row.lang_id: row.Present.Plural for row in apart} == {1: ["a"], 2: ["b"]}


def test_word_queries_keep_to_forms_or_take_infinitives_too(spark, verb):
    facts, _ = verb
    texts = spark.createDataFrame([(21, "vaar"), (20, "varen"), (9, "unused")], schemas.WORDS)
    only_form = facts.filter("word_id = 21")
    assert rows_of(words.all_words(only_form, texts)) == [(20, "varen", 4), (21, "vaar", 4)]
    assert rows_of(words.word_by_id(only_form, texts, 21)) == [(21, "vaar", 4)]
    assert rows_of(words.word_by_id(only_form, texts, 20)) == []
    assert rows_of(words.words_by_id(only_form, texts)) == [(21, "vaar", 4)]


def test_lowest_language_then_lowest_infinitive_wins(spark):
    texts = spark.createDataFrame([(n, f"w{n}") for n in range(1, 6)], schemas.WORDS)
    facts = spark.createDataFrame(
        [(1, 2, 1, 2, 1, None, 2), (2, 1, 1, 5, 1, None, 2), (3, 1, 1, 4, 1, None, 2)],
        schemas.VERB_FORMS,
    )
    assert rows_of(words.infinitive_of(facts, texts, "w1")) == [("w1", "w4", 4)]
    assert rows_of(words.infinitives(facts, texts)) == [("w1", "w4", 4)]
    assert rows_of(words.word_by_id(facts, texts, 1)) == [(1, "w1", 1)]


FACT = st.tuples(
    st.integers(1, 2),
    st.integers(1, 6),
    st.sampled_from([1, 1, 1, 1, 2, 3]),
    st.integers(1, 2),
    st.sampled_from([None, 0, 2, 4, 6, 8, 12, 14]),
    st.sampled_from([1, 1, 2, 3]),
)


def tables_by_hand(facts, texts):
    tables = defaultdict(lambda: {t: {s: [] for s in ALL_SLOTS} for t in ("Present", "Past")})
    for _, word, inf, tense, person, num in facts:
        slots = tables[texts[inf]]["Present" if tense == 1 else "Past"]
        if num == 2:
            slots["Plural"].append(texts[word])
        elif num == 1 and person:
            for bit, slot in [(2, "First"), (4, "Second"), (8, "Third")]:
                if person & bit:
                    slots[slot].append(texts[word])
    return {
        inf: {t: {s: sorted(forms) for s, forms in slots.items()} for t, slots in table.items()}
        for inf, table in tables.items()
    }


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(FACT, min_size=1, max_size=120))
def test_tables_equal_a_plain_loop(spark, facts):
    texts = {n: f"w{n}" for n in range(1, 7)}
    word_rows = spark.createDataFrame(list(texts.items()), schemas.WORDS)
    rows = spark.createDataFrame([(n, *fact) for n, fact in enumerate(facts)], schemas.VERB_FORMS)
    found = conjugation.conjugation_tables(rows, word_rows).collect()
    assert nested(found) == tables_by_hand(facts, texts)
    assert len(found) == len({row.Infinitive for row in found})


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(FACT, min_size=1, max_size=120))
def test_word_queries_equal_a_plain_loop(spark, facts):
    texts = {n: f"w{n}" for n in range(1, 7)}
    word_rows = spark.createDataFrame(list(texts.items()), schemas.WORDS)
    rows = spark.createDataFrame([(n, *fact) for n, fact in enumerate(facts)], schemas.VERB_FORMS)
    used = {(i, texts[i], f[0]) for f in facts for i in (f[1], f[2])}
    assert rows_of(words.all_words(rows, word_rows)) == sorted(used, key=repr)
    best = {}
    for lang, word, inf, *_ in facts:
        best[word] = min(best.get(word, (lang, inf)), (lang, inf))
    expected = [(texts[w], texts[inf], inf) for w, (_, inf) in best.items()]
    assert rows_of(words.infinitives(rows, word_rows)) == sorted(expected, key=repr)
    slots = Counter()
    for _, word, inf, tense, person, num in facts:
        if num == 2:
            slots[word, "Plural"] += 1
        elif num == 1:
            for bit, slot in [(2, "First"), (4, "Second"), (8, "Third")]:
                slots[word, slot] += bool((person or 0) & bit)
    got = Counter(rows_of(conjugation.person_slots(rows), "word_id", "slot"))
    assert got == +slots


def test_empty_results(spark, verb):
    facts, texts = verb
    assert not results.is_empty(texts) and results.is_empty(texts.limit(0))
    assert rows_of(results.none_exist(texts, "words")) == []
    assert rows_of(results.none_exist(texts.filter("id > 99"), "words")) == [("no words exist",)]


def test_json_sink_shows_nulls_and_empty_lists(spark, verb, tmp_path):
    path = str(tmp_path / "json")
    languages = spark.createDataFrame([(1, "dutch", None)], schemas.LANGUAGES)
    results.write_json(languages, path)
    (line,) = spark.read.text(path).collect()
    assert json.loads(line.value) == {"id": 1, "name": "dutch", "tag": None}
