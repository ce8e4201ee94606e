"""From pages to language sections, verb sections and templates.

All of it is narrow: rows leave a page's task only when a caller shuffles them.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.functions import wikitext


def language_sections(pages: DataFrame) -> DataFrame:
    """One row per language section: page_id, title, section (from 1), language, body."""
    return pages.select(
        "page_id", "title", F.posexplode(wikitext.sections(F.col("text"))).alias("at", "part")
    ).select(
        "page_id",
        "title",
        (F.col("at") + 1).alias("section"),
        F.lower("part.header").alias("language"),
        F.col("part.body").alias("body"),
    )


def verb_sections(pages: DataFrame, languages: Collection[str] | None = None) -> DataFrame:
    """Language sections with a verb, with the text of their first verb section.

    ``languages`` limits them to these lower-case names; None keeps all.
    """
    candidates = pages.filter(wikitext.may_have_verb(F.col("text"), languages))
    found = language_sections(candidates)
    if languages is not None:
        found = found.filter(F.col("language").isin(list(languages)))
    return found.filter(F.col("body").contains(wikitext.VERB_MARK)).select(
        "page_id",
        "title",
        "section",
        "language",
        wikitext.verb_section(F.col("body")).alias("verb"),
    )


def templates(pages: DataFrame, languages: Collection[str] | None = None) -> DataFrame:
    """One row per selected template: page_id, title, section, language, pos, template."""
    matches = verb_sections(pages, languages).select(
        "page_id",
        "title",
        "section",
        "language",
        wikitext.template_matches(F.col("verb")).alias("matches"),
    )
    return matches.select(
        "page_id",
        "title",
        "section",
        "language",
        F.posexplode(wikitext.kept_matches(F.col("matches"))).alias("pos", "match"),
    ).select(
        "page_id",
        "title",
        "section",
        "language",
        "pos",
        wikitext.template_text(F.col("match"), F.col("pos")).alias("template"),
    )
