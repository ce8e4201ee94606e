from __future__ import annotations

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows_of
from verbarium.operators.dictionary import vocabulary
from verbarium.operators.rules import RULES, conjugate
from verbarium.schemas import DECODED

FIELDS = ("title", "status", "infinitive", "tense", "num", "person")


def template_rows(spark, *pairs, language="dutch"):
    rows = [(n, title, 1, language, 0, template) for n, (title, template) in enumerate(pairs)]
    return spark.createDataFrame(
        rows,
        "page_id long, title string, section int, language string, pos int, template string",
    )


def decode(spark, *pairs):
    decoded = conjugate(template_rows(spark, *pairs)).orderBy("page_id")
    return [tuple(row) for row in decoded.select(*FIELDS).collect()]


def test_infinitive_and_finite_forms(spark):
    assert decode(
        spark,
        ("lopen", "{{nl-verb}}"),
        ("loop", "{{nl-verb form of|p=1|n=sg|t=pres|m=ind|lopen}}"),
        ("liep", "{{nl-verb form of|n=sg|t=past|m=ind|lopen}}"),
        ("loopt", "{{nl-verb form of|p=23|n=sg|t=pres|m=ind|lopen}}"),
        ("liepen", "{{nl-verb form of|p=1|n=pl|t=past|m=ind|lopen}}"),
    ) == [
        ("lopen", "ok", "lopen", "present", 2, None),
        ("loop", "ok", "lopen", "present", 1, 2),
        ("liep", "ok", "lopen", "past", 1, 14),
        ("loopt", "ok", "lopen", "present", 1, 12),
        ("liepen", "ok", "lopen", "past", 2, None),
    ]


def test_first_failing_check_names_the_status(spark):
    cases = {
        "{{nl-verb form of|n=pl|m=imp|lopen}}": "unsupported_mood",
        "# {{nl-verb}}": "unsupported_mood",
        "{{nl-verb|x}}": "unsupported_mood",
        "{{m=ind}}": "invalid_template",
        "{{nl-verb form of|n=sg|m=ind|x}}": "missing_tense",
        "{{nl-verb form of|n=sg|m=ind|t=pa}}": "invalid_tense",
        "{{nl-verb form of|n=sg|t=futu|m=ind|x}}": "invalid_tense",
        "{{nl-verb form of|t=past|m=ind|x}}": "missing_number",
        "{{nl-verb form of|n=xx|t=past|m=ind|x}}": "ok",
    }
    got = decode(spark, *[("w", template) for template in cases])
    assert [row[1] for row in got] == list(cases.values())


def test_persons(spark):
    cases = {"p=9|": 0, "p=112|": 6, "p=321|": 14, "p=1234|": 14, "p=x|": 14, "": 14, "p=3|p=1|": 8}
    templates = [f"{{{{v|{p}n=sg|t=pres|m=ind|x}}}}" for p in cases]
    assert [row[5] for row in decode(spark, *[("w", t) for t in templates])] == list(cases.values())


def test_parameters_are_found_anywhere_and_the_first_counts(spark):
    assert decode(
        spark,
        ("w", "{{v|form=ind|n=sg|t=pres|m=imp|x}}"),
        ("w", "{{v|n=sg|t=past|t=pres|m=ind|x|lang=nl}}"),
        ("w", "{{v|n=sg|t=past|m=ind|x}} of b}}"),
        ("a|b", "{{nl-verb}}"),
    ) == [
        ("w", "ok", "x", "present", 1, 14),
        ("w", "ok", "lang=nl", "past", 1, 14),
        ("w", "ok", "x}} of b", "past", 1, 14),
        ("a|b", "ok", "b", "present", 2, None),
    ]


def test_ignored_template_yields_no_row(spark):
    assert decode(spark, ("w", "{{nl-verb-form}}")) == []


def test_only_a_newline_ends_a_value(spark):
    got = decode(
        spark,
        ("w", "{{v|n=s\u2028|t=pre\u2028|m=ind|x}}"),
        ("w", "{{v|n=\u0085\r|t=past|m=ind|x}}"),
        ("w", "{{v|n=sg|t=pa\nst|t=pres|m=ind|x}}"),
    )
    assert [row[1] for row in got] == ["invalid_tense", "ok", "ok"]


def by_hand(title, template):
    if template == "{{nl-verb-form}}":
        return []
    if template == "{{nl-verb}}":
        template = "{{nl-verb form of|n=pl|t=pres|m=ind|" + title + "}}"

    def first(pattern):
        found = re.search(pattern, template)
        return found.group(1) if found else None

    mood, reference = first("m=(.{3})"), first(r"\|([^|]+)\}\}")
    tense, number, persons = first("t=(.{4})"), first("n=(.{2})"), first("p=([0-9]{1,3})")
    if mood != "ind":
        return [(title, "unsupported_mood", None, None, None, None)]
    if reference is None:
        return [(title, "invalid_template", None, None, None, None)]
    if tense is None:
        return [(title, "missing_tense", reference, None, None, None)]
    if tense not in ("pres", "past"):
        return [(title, "invalid_tense", reference, None, None, None)]
    if number is None:
        return [(title, "missing_number", reference, None, None, None)]
    person = None
    if number != "pl":
        person = sum({1: 2, 2: 4, 3: 8}.get(d, 0) for d in {int(c) for c in persons or "123"})
    name = "present" if tense == "pres" else "past"
    return [(title, "ok", reference, name, 2 if number == "pl" else 1, person)]


PARTS = st.sampled_from(
    ["m=ind", "m=imp", "m=", "t=pres", "t=past", "t=futu", "t=", "n=sg", "n=pl", "n=", "p=1", "p=23",
     "p=09", "x", "=", "\n", "}}", "{{", "lang=nl", "é", "\u2028"]
)
TEMPLATES = st.one_of(
    st.sampled_from(["{{nl-verb}}", "{{nl-verb-form}}", "# {{nl-verb}}"]),
    st.lists(PARTS, max_size=7).map(lambda parts: "{{v|" + "|".join(parts) + "}}"),
    st.lists(PARTS, max_size=7).map("".join),
)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["w", "a|b", "c}}"]), TEMPLATES), min_size=200, max_size=300))
def test_rules_equal_a_plain_walk_over_each_template(spark, pairs):
    got = rows_of(conjugate(template_rows(spark, *pairs)), *FIELDS)
    assert got == sorted((row for pair in pairs for row in by_hand(*pair)), key=repr)


def test_vocabulary_holds_words_of_accepted_moods_even_if_rejected_later(spark):
    decoded = conjugate(
        template_rows(
            spark,
            ("a", "{{v|n=sg|t=futu|m=ind|inf1}}"),
            ("b", "{{m=ind}}"),
            ("c", "{{v|n=sg|t=pres|m=imp|inf2}}"),
            ("d", "{{nl-verb}}"),
        )
    )
    assert rows_of(vocabulary(decoded)) == [("a",), ("b",), ("d",), ("inf1",)]


def test_each_language_meets_its_own_rules(spark):
    def row(infinitive):
        return F.struct(
            F.lit("past").alias("tense"),
            F.lit(None).alias("person"),
            F.lit(2).cast("long").alias("num"),
            F.lit(infinitive).alias("infinitive"),
            F.lit("ok").alias("status"),
        )

    def twice(title, template):
        """A rule set with two rows per template, or none; its fields have an order and types of their own."""
        return F.when(template != "{{none}}", F.array(row("x"), row("y")))

    rows = (
        template_rows(spark, ("a", "{{nl-verb}}"))
        .unionByName(template_rows(spark, ("b", "{{t}}"), language="english"))
        .unionByName(template_rows(spark, ("b", "{{none}}"), language="english"))
        .unionByName(template_rows(spark, ("c", "{{t}}"), language="french"))
        .unionByName(template_rows(spark, ("d", "{{t}}"), language="flemish"))
    )
    got = conjugate(rows, {**RULES, "English": twice, "flemish": twice})
    assert rows_of(got, "language", "title", "infinitive") == [
        ("dutch", "a", "a"),
        ("english", "b", "x"),
        ("english", "b", "y"),
        ("flemish", "d", "x"),
        ("flemish", "d", "y"),
    ]
    assert got.columns == [*rows.columns, *DECODED.names]
    assert rows_of(conjugate(rows, {})) == []
    assert rows_of(conjugate(rows), "title") == [("a",)]
