from __future__ import annotations

import uuid
from datetime import datetime

import pytest

from tests.conftest import rows_of
from verbarium import schemas
from verbarium.operators import accounts, quality
from verbarium.plans.registration import register
from verbarium.sources import tables

NOW = datetime(2020, 1, 2, 3, 4, 5)


@pytest.fixture
def users(spark):
    rows = [("a", 1, "ann", None, NOW), ("b", 2, "bob", 3, NOW), ("c", 9, "cas", 1, NOW)]
    return spark.createDataFrame(rows, schemas.USERS)


def requests_of(spark, *rows):
    return spark.createDataFrame(list(rows), "request_id long, name string")


def test_admins(spark, users):
    roles = tables.roles(spark)
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("nobody",), ("a",)], "id string")
    assert rows_of(accounts.admin_flags(asked, users, roles)) == sorted(
        [("a", True), ("a", True), ("b", False), ("c", False), ("nobody", False)], key=repr
    )
    assert rows_of(accounts.admins(users, roles), "id") == [("a",)]


def test_passwords_are_not_shown(spark, users):
    from pyspark.sql import functions as F

    shown = accounts.user_by_id(users.withColumn("password", F.lit("secret")), "b")
    assert rows_of(shown) == [("b", 2, "bob", 3, NOW)]


def test_first_request_for_a_free_name_succeeds(spark, users):
    asked = requests_of(spark, (5, "dan"), (3, "dan"), (4, "ann"), (6, "eve"), (7, "Ann"), (8, "dan"), (9, None), (3, "dan"))
    made = accounts.new_accounts(asked, users, tables.roles(spark)).collect()
    assert sorted((r.name, r.role_id, r.target_language_id) for r in made) == [
        ("Ann", 2, None),
        ("dan", 2, None),
        ("eve", 2, None),
    ]
    assert len({uuid.UUID(r.id) for r in made}) == 3
    assert all(r.created_at is not None for r in made)
    assert rows_of(accounts.rejected_requests(asked, users)) == [
        (4, "ann", "user ann already exists"),
        (5, "dan", "user dan already exists"),
        (8, "dan", "user dan already exists"),
        (9, None, "user without a name"),
    ]


def test_registered_accounts_are_stored_once(spark, store):
    first = register(store, requests_of(spark, (1, "ann"), (2, "ann")), 0)
    assert rows_of(first.rejected, "request_id") == [(2,)]
    assert rows_of(first.created, "id", "name") == rows_of(store.users, "id", "name")
    second = register(store, requests_of(spark, (3, "ann"), (4, "bob")), 1)
    assert rows_of(second.rejected, "request_id") == [(3,)]
    assert rows_of(second.created, "name") == [("bob",)]
    register(store, requests_of(spark, (3, "ann"), (4, "bob")), 1)
    assert rows_of(store.users, "name", "role_id") == [("ann", 2), ("bob", 2)]


def test_violations_of_seeded_bad_rows(spark, users):
    words = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (3, "b"), (None, "c")], schemas.WORDS)
    languages = spark.createDataFrame(
        [(1, "dutch", None), (2, "french", None), (3, "Dutch", "x"), (4, None, "x")], schemas.LANGUAGES
    )
    facts = spark.createDataFrame(
        [(1, 1, 1, 7, 1, None, 2), (2, 5, 7, 7, 3, None, None), (3, 1, 1, 1, 2, None, 1)],
        schemas.VERB_FORMS,
    )
    found = quality.violations(
        {
            "words": words,
            "languages": languages,
            "verb_forms": facts,
            "tenses": spark.createDataFrame([(1, "present"), (2, None)], schemas.TENSE),
            "roles": tables.roles(spark),
            "users": users,
        }
    )
    assert rows_of(found) == sorted(
        [
            ("not null", "words", "word", None, 1),
            ("not null", "words", "id", None, 1),
            ("not null", "tenses", "tense", None, 1),
            ("unique", "words", "id", "3", 2),
            ("not null", "languages", "name", None, 1),
            ("not null", "verb_forms", "num", None, 1),
            ("unique", "words", "word", "a", 2),
            ("unique", "languages", "tag", "x", 2),
            ("reference", "verb_forms", "lang_id", "5", 1),
            ("reference", "verb_forms", "word_id", "7", 1),
            ("reference", "verb_forms", "inf_id", "7", 2),
            ("reference", "verb_forms", "tense_id", "3", 1),
            ("reference", "users", "role_id", "9", 1),
        ],
        key=repr,
    )
