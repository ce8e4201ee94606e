from __future__ import annotations

import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.conftest import rows_of
from verbarium.operators.extraction import language_sections, templates, verb_sections
from verbarium.operators import pages as page_operators
from verbarium.operators.pages import drop_special_pages, find_page, first_pages, nth_id

# A page of three languages. Latin has its verb after a noun, Danish has two verb sections of which
# the second is not looked at, and Welsh has a heading of another level and a list of forms.
GOLDEN = """{{see|Ama}}
==Latin==
===Etymology===
From an older {{m|la|amo}}.

====Noun====
{{la-noun|ama}}

====Verb====
# {{verb-form|la}} of {{m|la|amo}}
# {{inflected|la|amo|2|imp}}
Some prose with {{gloss|love!}} in it.

==Danish==

===Verb===
{{da-verb|ama}} {{ignored}}

===Verb===
{{verb form|da}}
# {{never|seen}}

==Welsh==
====Verb====
{{cy-head|verb form}}
* {{cy-form|1|amu}}
# {{cy-form|2|amu}}
# {{cy-form|3|amu}}
== References ==
* {{R:GPC}}
"""


def test_golden_page_has_the_expected_templates_per_language(make_pages):
    found = templates(make_pages((1, "ama", GOLDEN)))
    counts = Counter(row.language for row in found.collect())
    assert counts == {"latin": 4, "danish": 1, "welsh": 4}


def test_order_and_text_of_selected_templates(make_pages):
    found = templates(make_pages((1, "ama", GOLDEN)), ["welsh", "latin"])
    assert rows_of(found, "language", "section", "pos", "template") == [
        ("latin", 1, 0, "# {{verb-form|la}}"),
        ("latin", 1, 1, "{{m|la|amo}}"),
        ("latin", 1, 2, "{{inflected|la|amo|2|imp}}"),
        ("latin", 1, 3, "{{gloss|love!}}"),
        ("welsh", 3, 0, "{{cy-head|verb form}}"),
        ("welsh", 3, 1, "{{cy-form|1|amu}}"),
        ("welsh", 3, 2, "{{cy-form|2|amu}}"),
        ("welsh", 3, 3, "{{cy-form|3|amu}}"),
    ]


def test_no_language_registered_gives_nothing(make_pages):
    assert templates(make_pages((1, "ama", GOLDEN)), []).isEmpty()


@pytest.mark.parametrize(
    "text, expected",
    [
        # Header at the end without a newline, or with blanks behind it, is none.
        ("==A==\nx\n==B==", [("a", "x\n==B==")]),
        ("==A==\nx\n==B== \ny", [("a", "x\n==B== \ny")]),
        # The name is not trimmed, and may span lines.
        ("== A ==\nx", [(" a ", "x")]),
        ("==A\nB==\nx", [("a\nb", "x")]),
        # Adjacent headers leave an empty section.
        ("==A==\n==B==\nx", [("a", ""), ("b", "x")]),
        ("before\n===A===\nx", []),
        ("x ==A==\ny", []),
        ("\x01==A==\n==B==\n\x02x\x01", [("b", "\x02x\x01")]),
        ("", []),
        # Only a newline ends a line.
        ("\u2028==A==\nx", []),
        ("\u0085==A==\nx", []),
        ("\r==A==\nx", []),
        ("==A==\r\nx", []),
    ],
)
def test_language_sections(make_pages, text, expected):
    got = language_sections(make_pages((1, "t", text))).orderBy("section")
    assert [(row.language, row.body) for row in got.collect()] == expected


@pytest.mark.parametrize(
    "body, expected",
    [
        ("===Verb===\na\n===Noun===\nb", "\na\n"),
        ("===Verb===\na", "\na"),
        ("====Verb====\na\n=====Sub=====\nb", "\na\n"),
        ("===Verb===\na\n===Verb===\nb", "\na\n"),
        ("===Noun===\na\n===Verb=== \nb", ""),
        ("x ===Verb===\na", ""),
        ("===Verb===", ""),
        ("===Verb=== a\n===Verb===\nb ===C===\nd", "\nb ===C===\nd"),
        ("===Verb===\r\na", ""),
        ("===Verb===\na\n===Noun=== \nb\n== ==\n", "\na\n===Noun=== \nb\n"),
    ],
)
def test_first_verb_section(make_pages, body, expected):
    got = verb_sections(make_pages((1, "t", f"==A==\n{body}")))
    assert [row.verb for row in got.collect()] == [expected]


@pytest.mark.parametrize(
    "verb, expected",
    [
        ("{{a}} {{b}}", ["{{a}}"]),
        ("# {{a}} {{b}}", ["# {{a}}"]),
        ("{{verb form}} # {{b}}\n# {{c}}x", ["{{verb form}}", "{{b}}", "{{c}}"]),
        ("# {{verb-form}}# {{b}}", ["# {{verb-form}}", "{{b}}"]),
        ("{{a}} b}} {{verb form}}", ["{{a}} b}}"]),
        ("{{verb form\n}}\n}} {{x}}", ["{{verb form\n}}\n}}", "{{x}}"]),
        ("{{a {{verb form}} {{b}}", ["{{verb form}}", "{{b}}"]),
        ("{{{a}}} {{b}}", ["{{a}}}"]),
        ("no templates", []),
        ("{{open", []),
    ],
)
def test_template_selection(make_pages, verb, expected):
    got = templates(make_pages((1, "t", f"==A==\n===Verb===\n{verb}"))).orderBy("pos")
    assert [row.template for row in got.collect()] == expected


def by_hand(text: str) -> list[tuple[int, str, int, str]]:
    """The same extraction, page by page in plain Python."""
    found = []
    heads = list(re.finditer(r"^==([^=]+)==\n", text, re.M))
    for number, head in enumerate(heads, 1):
        end = heads[number].start() if number < len(heads) else len(text)
        body = text[head.end() : end]
        start = re.search(r"^={3,}Verb={3,}$", body, re.M)
        if "===Verb===" not in body or not start:
            continue
        rest = body[start.end() :]
        stop = re.search(r"^={2,}.*={2,}$", rest, re.M)
        matches = list(re.finditer(r"(# )?(\{\{[^{]*\}\})", rest[: stop.start()] if stop else rest))
        if not matches:
            continue
        chosen = [matches[0].group(0)]
        if re.search("verb[ -]form", chosen[0]):
            chosen += [match.group(2) for match in matches[1:]]
        found += [(number, head.group(1).lower(), pos, text) for pos, text in enumerate(chosen)]
    return found


PIECES = st.sampled_from(
    ["==Dutch==\n", "==A==\n", "==", "=", "===Verb===\n", "====Verb====\n", "===Verb===", "\n",
     "===X===\n", "{{a}}", "{{verb form}}", "# {{b|c}}", "{{", "}}", "# ", "verb-form", "x", " ",
     "\r", "\u2028", "\u0085", "{", "|"]
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, max_size=25).map("".join), min_size=200, max_size=300))
def test_extraction_equals_a_plain_walk_over_each_page(make_pages, texts):
    found = templates(make_pages(*[(n, "t", text) for n, text in enumerate(texts)]))
    got = rows_of(found, "page_id", "section", "language", "pos", "template")
    expected = [(n, *row) for n, text in enumerate(texts) for row in by_hand(text)]
    assert got == sorted(expected, key=repr)


def test_special_pages(make_pages):
    titles = ["User:x", "Talk:", "Module:a:b", "user:x", "User talk:x", ":x", "x", "Userx:", "Wiktionary:x"]
    kept = drop_special_pages(make_pages(*[(n, t, "") for n, t in enumerate(titles)]))
    assert [row[0] for row in rows_of(kept, "page_id")] == [3, 4, 5, 6, 7, 8]


def test_find_page_takes_the_lowest_id_and_no_special_page(make_pages):
    pages = make_pages((5, "a", "late"), (2, "a", "early"), (1, "User:a", ""), (0, "A", ""))
    assert rows_of(find_page(pages, "a")) == [(2, "a", "early")]
    assert rows_of(find_page(pages, "User:a")) == []
    assert find_page(pages, "a", early_stop=True).count() == 1


@pytest.mark.parametrize("limit", [1, 2, 3, 5, 6, 7, 100])
def test_page_limit_counts_other_than_special_pages(make_pages, limit):
    ids = [3, 900_000, 1_048_575, 1_048_576, 5_000_000, 5_000_001]
    pages = make_pages(*[(n, "t", "") for n in ids], (1, "User:x", ""), (4_999_999, "Talk:x", ""))
    assert rows_of(first_pages(pages, limit), "page_id") == sorted([(n,) for n in ids[:limit]], key=repr)


def test_page_limit_with_repeated_and_missing_ids(make_pages):
    pages = make_pages((4, "b", ""), (None, "y", ""), (4, "a", ""), (9, "c", "1"), (9, "c", "2"), (None, "x", ""))
    ordered = [(4, "a"), (4, "b"), (9, "c"), (None, "x"), (None, "y")]
    for limit in range(1, 7):
        found = {(r.page_id, r.title) for r in first_pages(pages, limit).collect()}
        assert found == set(ordered[:limit])
    # Rows with the same id and title are one page.
    assert first_pages(pages, 3).count() == 4


@pytest.mark.parametrize("cells", [64, 1 << 14])
def test_selected_ids_against_a_sort(spark, monkeypatch, cells):
    """Sparse, dense, negative, repeated and missing ids, in many rounds."""
    monkeypatch.setattr(page_operators, "CELLS", cells)
    ids = [-(1 << 63), (1 << 63) - 1, -5, -5, 0, *range(100, 130), 1 << 40, (1 << 40) + 1, None, None, None]
    keys = spark.createDataFrame([(n, "t") for n in ids], "page_id long, title string").cache()
    known = sorted(n for n in ids if n is not None)
    for n in (1, 3, 5, 17, len(known) - 1, len(known)):
        found, before = nth_id(keys, n)
        assert found == known[n - 1] and before == sum(i < found for i in known)
    assert nth_id(keys, len(known) + 1) == (None, len(known))
    assert nth_id(keys, len(ids)) is None and nth_id(keys.limit(0), 1) is None


def test_page_limit_over_many_copies(spark):
    rows = spark.range(3000).selectExpr("id % 30 AS page_id", "concat('t', id % 60) AS title", "id AS copy")
    for limit in (7, 59, 61):
        kept = first_pages(rows, limit)
        found = {(r.page_id, r.title) for r in kept.collect()}
        ordered = sorted({(r.page_id, r.title) for r in rows.collect()})
        assert found == set(ordered[:limit]) and kept.count() == 50 * len(found)


def test_page_limit_bounds(make_pages):
    pages = make_pages((1, "a", ""))
    assert first_pages(pages, -1).count() == 1
    assert first_pages(pages.limit(0), 3).count() == 0
    for bad in (0, -2):
        with pytest.raises(ValueError):
            first_pages(pages, bad)
