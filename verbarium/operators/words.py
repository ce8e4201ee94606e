"""Queries over words and the verb forms that use them.

They ask which forms, languages and infinitives go together, so ``verb_forms`` may also be the
store's ``form_index``, which holds just that, by form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def all_words(verb_forms: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct (id, text, language) of words used as a form or as an infinitive.

    Joining on "is the form or is the infinitive" would compare every pair of rows; stacking
    both ids first leaves an equi-join over distinct ids.
    """
    used = verb_forms.select(
        F.col("lang_id").alias("language"), F.explode(F.array("word_id", "inf_id")).alias("id")
    ).distinct()
    return used.join(words, "id").select("id", F.col("word").alias("text"), "language")


def word_by_id(verb_forms: DataFrame, words: DataFrame, word_id: int) -> DataFrame:
    """The word with this id if it is the form of some verb; the lowest language id wins."""
    form = (
        verb_forms.filter(F.col("word_id") == word_id)
        .groupBy(F.col("word_id").alias("id"))
        .agg(F.min("lang_id").alias("language"))
    )
    found = words.filter(F.col("id") == word_id)
    return form.join(found, "id").select("id", F.col("word").alias("text"), "language")


def words_by_id(verb_forms: DataFrame, words: DataFrame) -> DataFrame:
    """``word_by_id`` for every word that is the form of some verb."""
    forms = verb_forms.groupBy(F.col("word_id").alias("id")).agg(F.min("lang_id").alias("language"))
    return forms.join(words, "id").select("id", F.col("word").alias("text"), "language")


def _first_infinitive(forms: DataFrame) -> DataFrame:
    """(word_id, inf_id): of several infinitives the lowest (lang_id, inf_id) wins.

    Both steps combine on the map side, so a word with very many rows weighs no more than
    any other by the time it is shuffled. A minimum over structs would need a sort instead.
    """
    per_language = forms.groupBy("word_id", "lang_id").agg(F.min("inf_id").alias("inf_id"))
    return per_language.groupBy("word_id").agg(F.min_by("inf_id", "lang_id").alias("inf_id"))


def infinitives(verb_forms: DataFrame, words: DataFrame) -> DataFrame:
    """(word, infinitive, inf_id) for every word that is a verb form."""
    chosen = _first_infinitive(verb_forms)
    form_text = words.select(F.col("id").alias("word_id"), "word")
    inf_text = words.select(F.col("id").alias("inf_id"), F.col("word").alias("infinitive"))
    return (
        chosen.join(form_text, "word_id")
        .join(inf_text, "inf_id")
        .select("word", "infinitive", "inf_id")
    )


def infinitive_of(verb_forms: DataFrame, words: DataFrame, word: str) -> DataFrame:
    """``infinitives`` for a single word; at most one row."""
    inf_text = words.select(F.col("id").alias("inf_id"), F.col("word").alias("infinitive"))
    found = inf_text.filter(F.col("inf_id") == F.lit(infinitive_id(verb_forms, words, word)))
    return found.select(F.lit(word).alias("word"), "infinitive", "inf_id")


def infinitive_id(verb_forms: DataFrame, words: DataFrame, word: str) -> int | None:
    """The id of the infinitive of one word, None for a word that is no form.

    Two small jobs, so that each id reaches the next scan as a constant, by which it skips files.
    """
    word_id = words.filter(F.col("word") == word).agg(F.min("id")).first()[0]
    if word_id is None:
        return None
    chosen = _first_infinitive(verb_forms.filter(F.col("word_id") == word_id)).select("inf_id").first()
    return chosen and chosen[0]


def usable_lookups(lookups: DataFrame) -> DataFrame:
    """Lookups that ask for something: an empty search string is not looked up."""
    return lookups.filter(F.length("word") > 0)


def _asked_ids(lookups: DataFrame, words: DataFrame) -> DataFrame:
    """(word_id, word) of the different words asked for."""
    asked = lookups.select("word").distinct()
    return words.join(asked, "word").select(F.col("id").alias("word_id"), "word")


def asked_infinitives(lookups: DataFrame, verb_forms: DataFrame, words: DataFrame) -> DataFrame:
    """``infinitives`` for the words asked for.

    Only their facts are aggregated: the join with what is asked stands below the aggregation,
    and few words reach the scan of the facts as a filter.
    """
    ids = _asked_ids(lookups, words)
    facts = verb_forms.join(ids.select("word_id"), "word_id", "left_semi")
    inf_text = words.select(F.col("id").alias("inf_id"), F.col("word").alias("infinitive"))
    chosen = _first_infinitive(facts).join(ids, "word_id")
    return chosen.join(inf_text, "inf_id").select("word", "infinitive", "inf_id")


def look_up_infinitives(lookups: DataFrame, verb_forms: DataFrame, words: DataFrame) -> DataFrame:
    """Each lookup with its word's infinitive; lookups of unknown words are absent."""
    asked = usable_lookups(lookups)
    return asked.join(asked_infinitives(asked, verb_forms, words), "word")


def missing_words(lookups: DataFrame, verb_forms: DataFrame, words: DataFrame) -> DataFrame:
    """Lookups whose word is no verb form, with the error message."""
    asked = usable_lookups(lookups)
    ids = _asked_ids(asked, words)
    used = verb_forms.join(ids.select("word_id"), "word_id", "left_semi").select("word_id").distinct()
    forms = ids.join(used, "word_id", "left_semi").select("word")
    return asked.join(forms, "word", "left_anti").withColumn(
        "error", F.concat(F.lit("word "), F.col("word"), F.lit(" does not exist"))
    )
