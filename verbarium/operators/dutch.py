"""Dutch verb templates: mood, tense, number, person and infinitive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbarium.functions.inflection import person_bits
from verbarium.schemas import PLURAL, SINGULAR

# Template names, parameters and their patterns.
INFINITIVE = "{{nl-verb}}"
IGNORED = "{{nl-verb-form}}"
OWN_PLURAL = "{{nl-verb form of|n=pl|t=pres|m=ind|"
MOOD = r"(?d)m=(.{3})"
TENSE = r"(?d)t=(.{4})"
NUMBER = r"(?d)n=(.{2})"
PERSON = r"p=([0-9]{1,3})"
REFERENCE = r"\|([^|]+)\}\}"
INDICATIVE = "ind"
TENSE_NAMES = {"pres": "present", "past": "past"}


def dutch_rules(title: Column, template: Column) -> Column:
    """Decode a template: no row for the ignored one, else one with status, infinitive, tense,
    num and person.

    ``status`` is 'ok' or the first check that failed. The infinitive stands wherever the mood
    was accepted, for such words enter the dictionary even if the form is rejected later.
    """
    # An infinitive is its own present plural.
    effective = F.when(
        template == INFINITIVE, F.concat(F.lit(OWN_PLURAL), title, F.lit("}}"))
    ).otherwise(template)
    captures = once(F.array(effective), captured)
    return F.when(template != IGNORED, once(captures, judged))


def once(values: Column, work: Callable[[Column], Column]) -> Column:
    """``work`` on every value of an array. As a variable of it a value is computed once, however
    often ``work`` names it."""
    return F.transform(values, work)


def captured(effective: Column) -> Column:
    def first(pattern: str) -> Column:
        return F.regexp_extract(effective, pattern, 1)

    return F.struct(
        first(MOOD).alias("mood"),
        first(REFERENCE).alias("reference"),
        first(TENSE).alias("tense_code"),
        first(NUMBER).alias("number_code"),
        first(PERSON).alias("persons"),
    )


def judged(captures: Column) -> Column:
    mood, reference, tense_code, number_code, persons = (
        captures[name] for name in ("mood", "reference", "tense_code", "number_code", "persons")
    )
    # Every capture has at least one character, so '' means no match.
    accepted = mood == INDICATIVE
    referring = accepted & (reference != "")
    known_tense = tense_code.isin(list(TENSE_NAMES))
    ok = referring & known_tense & (number_code != "")
    status = (
        F.when(ok, "ok")
        .when(~accepted, "unsupported_mood")
        .when(~referring, "invalid_template")
        .when(tense_code == "", "missing_tense")
        .when(~known_tense, "invalid_tense")
        .otherwise("missing_number")
    )
    plural = number_code == "pl"
    tense = tense_code
    for code, name in TENSE_NAMES.items():
        tense = F.when(tense_code == code, name).otherwise(tense)
    return F.struct(
        status.alias("status"),
        F.when(referring, reference).alias("infinitive"),
        F.when(ok, tense).alias("tense"),
        F.when(ok, F.when(plural, PLURAL).otherwise(SINGULAR)).alias("num"),
        F.when(ok & ~plural, person_bits(persons)).alias("person"),
    )
