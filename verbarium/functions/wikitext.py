"""Column expressions over wiki titles and wikitext.

``(?d)`` makes Java regexes treat only ``\\n`` as a line end, as the expected results do.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Title prefixes of pages that hold no words.
SPECIAL_NAMESPACES = ["User", "Template", "Module", "Category", "Thread", "Talk"]

# The wikitext patterns.
VERB_MARK = "===Verb==="
LANGUAGE_HEADER = r"(?md)^==([^=]+)==\n"
FIRST_VERB_SECTION = r"(?md)^={3,}Verb={3,}$((?s:.*?))(?:^={2,}.*={2,}$|\z)"
TEMPLATE = r"(# )?(\{\{[^{]*\}\})"
VERB_FORM = r"verb( |-)form"
LIST_PREFIX = "# "

# More elements than an array of a page's pieces can have.
REST = 1 << 30


def is_special(title: Column) -> Column:
    """True where the text before the first colon names a special namespace."""
    return title.contains(":") & F.substring_index(title, ":", 1).isin(SPECIAL_NAMESPACES)


def sections(text: Column) -> Column:
    """Array of (header, body), one per level-two header, in page order.

    The text before the first header belongs to no section.
    """
    headers = F.regexp_extract_all(text, F.lit(LANGUAGE_HEADER), 1)
    bodies = F.slice(F.split(text, LANGUAGE_HEADER, -1), 2, REST)
    return F.arrays_zip(headers.alias("header"), bodies.alias("body"))


def may_have_verb(text: Column, languages: Iterable[str] | None = None) -> Column:
    """A substring test that is true for every page with a verb section in ``languages``.

    It is much cheaper than the regexes and spares most pages from them.
    """
    test = text.contains(VERB_MARK)
    if languages is None:
        return test
    # Most headers have one capital. Only pages without such a header are lower-cased.
    usual, named, low = F.lit(False), F.lit(False), F.lower(text)
    for language in languages:
        if language.isascii():
            usual = usual | text.contains(f"=={language.capitalize()}==\n")
        named = named | low.contains(f"=={language}==\n")
    return test & (usual | named)


def verb_section(body: Column) -> Column:
    """The first verb section of a language section, or '' where there is none."""
    return F.regexp_extract(body, FIRST_VERB_SECTION, 1)


def template_matches(verb: Column) -> Column:
    """All template matches, each with its list prefix if it has one."""
    return F.regexp_extract_all(verb, F.lit(TEMPLATE), 0)


def kept_matches(matches: Column) -> Column:
    """The first match alone, or all of them where the first announces a verb form."""
    return F.when(F.get(matches, F.lit(0)).rlike(VERB_FORM), matches).otherwise(
        F.slice(matches, 1, 1)
    )


def template_text(match: Column, pos: Column) -> Column:
    """The template of a match: the first keeps its list prefix, later ones lose it."""
    return F.when(
        (pos > 0) & match.startswith(LIST_PREFIX), F.substr(match, F.lit(len(LIST_PREFIX) + 1))
    ).otherwise(match)
