"""Verb-form facts: decoded templates with dictionary ids in place of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.schemas import FORM_INDEX, PLURAL, VERB_FORMS


def text_forms(decoded: DataFrame) -> DataFrame:
    """The accepted rows, one per form and still as text; duplicates are kept."""
    return decoded.filter(F.col("status") == "ok").select(
        "language",
        F.col("title").alias("word"),
        "infinitive",
        "tense",
        # A plural form is stored without a person.
        F.when(F.col("num") != PLURAL, F.col("person")).alias("person"),
        "num",
        *[c for c in decoded.columns if c == "id"],
    )


def index_forms(verb_forms: DataFrame) -> DataFrame:
    """The different (word_id, lang_id, inf_id), ranged by form.

    Queries by form need no more of the facts, which lie by infinitive: their ranges of forms
    overlap, so a lookup there reads every file, and here few.
    """
    rows = verb_forms.select(*FORM_INDEX.names).distinct()
    return rows.repartitionByRange("word_id", "lang_id", "inf_id").sortWithinPartitions("word_id", "lang_id", "inf_id")


def encode_facts(
    decoded: DataFrame, words: DataFrame, languages: DataFrame, tenses: DataFrame
) -> DataFrame:
    """Replace word, infinitive, language and tense by their ids.

    The word joins are left to the optimizer: it broadcasts a dictionary that is measured to
    be small and otherwise shuffles, splitting the partitions of hot infinitives. So is the one
    with the languages. Tenses are bounded by grammar.
    """
    forms = text_forms(decoded)
    form_ids = words.select(F.col("id").alias("word_id"), "word")
    inf_ids = words.select(F.col("id").alias("inf_id"), F.col("word").alias("infinitive"))
    language_ids = languages.select(F.col("id").alias("lang_id"), F.col("name").alias("language"))
    tense_ids = tenses.select(F.col("id").alias("tense_id"), "tense")
    encoded = (
        forms.join(language_ids, "language")
        .join(F.broadcast(tense_ids), "tense")
        .join(form_ids, "word")
        .join(inf_ids, "infinitive")
    )
    return encoded.select(*[c for c in VERB_FORMS.names if c in encoded.columns])
