"""Conjugation tables: the forms of an infinitive by tense and person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbarium.functions.inflection import SLOTS, has_bit, slot_mask
from verbarium.operators.words import asked_infinitives, infinitive_id, usable_lookups
from verbarium.schemas import PAST_ID, PRESENT_ID
from verbarium.session import scratch_path, stage

TENSE_FIELDS = {"Present": PRESENT_ID, "Past": PAST_ID}
ROW_LABELS = {
    "First": "1st person singular",
    "Second": "2nd person singular",
    "Third": "3rd person singular",
    "Plural": "Plural",
}


def person_slots(verb_forms: DataFrame) -> DataFrame:
    """One row per table slot that a form fills."""
    bits = F.array(*[F.struct(F.lit(n).alias("slot"), F.lit(b).alias("bit")) for n, b in SLOTS.items()])
    return (
        verb_forms.withColumn("mask", slot_mask(F.col("num"), F.col("person")))
        .filter(F.col("mask") != 0)
        .withColumn("filled", F.explode(bits))
        .filter(F.col("mask").bitwiseAND(F.col("filled.bit")) != 0)
        .select(*verb_forms.columns, "filled.slot")
    )


def counted_forms(verb_forms: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, tense_id, mask, word_id) with the number of equal facts.

    Repeated facts collapse before the shuffle, and its key spreads the forms of a single
    infinitive over all tasks.
    """
    return (
        verb_forms.withColumn("mask", slot_mask(F.col("num"), F.col("person")))
        # Facts that fill no slot still make their infinitive known.
        .withColumn("mask", F.coalesce("mask", F.lit(0)))
        .groupBy(*keys, "tense_id", "mask", "word_id")
        .agg(F.count("*").alias("copies"))
    )


def conjugation_slots(verb_forms: DataFrame, words: DataFrame) -> DataFrame:
    """(inf_id, infinitive, tense, slot, form, copies): every filled slot as a row of its own.

    Nothing is gathered, and a hot infinitive is spread over all tasks.
    """
    counted = counted_forms(verb_forms, ["inf_id"])
    bits = F.array(*[F.struct(F.lit(n).alias("slot"), F.lit(b).alias("bit")) for n, b in SLOTS.items()])
    filled = F.filter(bits, lambda x: F.col("mask").bitwiseAND(x["bit"]) != 0)
    names = F.create_map(*[F.lit(x) for name, n in TENSE_FIELDS.items() for x in (n, name)])
    rows = counted.select(
        "inf_id", "word_id", F.element_at(names, F.col("tense_id")).alias("tense"), "copies", F.explode(filled).alias("at")
    ).filter(F.col("tense").isNotNull())
    # Forms that share a slot through different masks are one row.
    rows = rows.groupBy("inf_id", "tense", F.col("at.slot").alias("slot"), "word_id").agg(F.sum("copies").alias("copies"))
    form_text = words.select(F.col("id").alias("word_id"), F.col("word").alias("form"))
    inf_text = words.select(F.col("id").alias("inf_id"), F.col("word").alias("infinitive"))
    return rows.join(form_text, "word_id").join(inf_text, "inf_id").select(
        "inf_id", "infinitive", "tense", "slot", "form", "copies"
    )


def conjugation_tables(verb_forms: DataFrame, words: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(inf_id, Infinitive, Present, Past): one row per infinitive, a sorted list per slot.

    Repeated forms are kept and an empty slot is an empty list. The table of one infinitive is
    one answer, so it must fit into a row; ``conjugation_slots`` has the same content without
    that bound. ``keys`` names further columns that keep tables apart, such as lang_id.
    """
    keys = [*(keys or []), "inf_id"]
    counted = counted_forms(verb_forms, keys)
    form_text = words.select(F.col("id").alias("word_id"), F.col("word").alias("form"))
    tables = counted.join(form_text, "word_id").groupBy(*keys).agg(
        *[_tense(tense_id).alias(field) for field, tense_id in TENSE_FIELDS.items()]
    )
    inf_text = words.select(F.col("id").alias("inf_id"), F.col("word").alias("Infinitive"))
    return tables.join(inf_text, "inf_id").select(*keys, "Infinitive", *TENSE_FIELDS)


def _tense(tense_id: int) -> Column:
    """Struct of the four form lists of a tense."""

    def forms(bit: int) -> Column:
        here = (F.col("tense_id") == tense_id) & has_bit(F.col("mask"), bit)
        copies = F.array_repeat("form", F.col("copies").cast("int"))
        return F.sort_array(F.flatten(F.collect_list(F.when(here, copies))))

    return F.struct(*[forms(bit).alias(name) for name, bit in SLOTS.items()])


def conjugation_table(
    verb_forms: DataFrame, words: DataFrame, word: str, form_index: DataFrame | None = None
) -> DataFrame:
    """The table of the infinitive that ``word`` is a form of; empty for an unknown word."""
    target = infinitive_id(verb_forms if form_index is None else form_index, words, word)
    return conjugation_tables(verb_forms.filter(F.col("inf_id") == F.lit(target)), words)


def look_up_tables(
    lookups: DataFrame, verb_forms: DataFrame, words: DataFrame, form_index: DataFrame | None = None
) -> DataFrame:
    """(word, Infinitive, Present, Past) for each lookup; a blank table for unknown words.

    The infinitives asked for are found first and staged; only their facts are read, and each
    table is made once, however many words ask for it.
    """
    asked = usable_lookups(lookups)
    known = asked_infinitives(asked, verb_forms if form_index is None else form_index, words)
    known = stage(known.select("word", "inf_id"), scratch_path(lookups.sparkSession, "asked"))
    facts = verb_forms.join(known.select("inf_id").distinct(), "inf_id", "left_semi")
    found = known.join(conjugation_tables(facts, words), "inf_id").drop("inf_id")
    answered = asked.join(found, "word", "left")
    return answered.select(
        *lookups.columns,
        F.coalesce("Infinitive", F.lit("")).alias("Infinitive"),
        *[
            F.struct(
                *[
                    F.coalesce(F.col(f"{tense}.{slot}"), F.array().cast("array<string>")).alias(slot)
                    for slot in SLOTS
                ]
            ).alias(tense)
            for tense in TENSE_FIELDS
        ],
    )


def flat_tables(tables: DataFrame) -> DataFrame:
    """Four display rows per table: label, Present and Past as comma-separated text."""
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                *[F.array_join(F.col(f"{tense}.{slot}"), ", ").alias(tense) for tense in TENSE_FIELDS],
            )
            for slot, label in ROW_LABELS.items()
        ]
    )
    rest = [c for c in tables.columns if c not in TENSE_FIELDS]
    return tables.select(*rest, F.inline(rows))
