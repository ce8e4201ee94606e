"""Schemas of the stored tables and the fixed value codes."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
SINGULAR = 1
PLURAL = 2
FIRST = 2
SECOND = 4
THIRD = 8
ALL_PERSONS = FIRST + SECOND + THIRD
PRESENT_ID = 1
PAST_ID = 2
TENSES = [(PRESENT_ID, "present"), (PAST_ID, "past")]
ROLES = [(1, "admin"), (2, "user")]


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


PAGES = _schema(page_id=T.LongType(), title=T.StringType(), text=T.StringType())

LANGUAGES = _schema(id=T.IntegerType(), name=T.StringType(), tag=T.StringType())
WORDS = _schema(id=T.LongType(), word=T.StringType())
TENSE = _schema(id=T.IntegerType(), tense=T.StringType())
ROLE = _schema(id=T.IntegerType(), role=T.StringType())
VERB_FORMS = _schema(
    id=T.LongType(),
    lang_id=T.IntegerType(),
    word_id=T.LongType(),
    inf_id=T.LongType(),
    tense_id=T.IntegerType(),
    person=T.IntegerType(),
    num=T.IntegerType(),
)
# The different (form, language, infinitive) of the facts, laid out for lookups by form.
FORM_INDEX = _schema(word_id=T.LongType(), lang_id=T.IntegerType(), inf_id=T.LongType())
DECODED = _schema(
    status=T.StringType(),
    infinitive=T.StringType(),
    tense=T.StringType(),
    num=T.IntegerType(),
    person=T.IntegerType(),
)
REJECTS = _schema(
    page_id=T.LongType(),
    title=T.StringType(),
    language=T.StringType(),
    section=T.IntegerType(),
    pos=T.IntegerType(),
    template=T.StringType(),
    status=T.StringType(),
)
CORRUPT = _schema(record=T.StringType())
BATCHES = _schema(id=T.LongType(), last_word=T.LongType(), last_fact=T.LongType(), done=T.BooleanType())
# Passwords are left out: nothing here reads them.
USERS = _schema(
    id=T.StringType(),
    role_id=T.IntegerType(),
    name=T.StringType(),
    target_language_id=T.IntegerType(),
    created_at=T.TimestampType(),
)

# The primary key of every table is its id: not null and unique.
REQUIRED = {
    "languages": ["id", "name"],
    "words": ["id", "word"],
    "tenses": ["id", "tense"],
    "roles": ["id", "role"],
    "verb_forms": ["id", "lang_id", "word_id", "inf_id", "tense_id", "num"],
    "users": ["id", "role_id", "name", "created_at"],
}
UNIQUE = {
    "languages": ["id", "name", "tag"],
    "words": ["id", "word"],
    "tenses": ["id", "tense"],
    "roles": ["id", "role"],
    "verb_forms": ["id"],
    "users": ["id", "name"],
}
# (table, column) -> the table whose id it holds
FOREIGN = {
    ("verb_forms", "lang_id"): "languages",
    ("verb_forms", "word_id"): "words",
    ("verb_forms", "inf_id"): "words",
    ("verb_forms", "tense_id"): "tenses",
    ("users", "role_id"): "roles",
    ("users", "target_language_id"): "languages",
}
