"""Insert-if-absent dictionaries of words and languages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.operators.numbering import numbered


def vocabulary(decoded: DataFrame) -> DataFrame:
    """Distinct words of decoded templates: titles and infinitives where the mood was accepted."""
    accepted = decoded.filter(F.col("status") != "unsupported_mood")
    return (
        accepted.select(F.explode(F.array("title", "infinitive")).alias("word"))
        .filter(F.col("word").isNotNull())
        .distinct()
    )


def new_words(found: DataFrame, known: DataFrame, path: str, last_id: int) -> tuple[DataFrame, int]:
    """Rows (id, word) for the words of ``found``, each once, that ``known`` lacks, and the last id.

    Known words keep their ids; new ones follow ``last_id`` in word order. ``path`` takes the
    intermediate table.
    """
    fresh = found.select("word").join(known.select("word"), "word", "left_anti")
    return numbered(fresh, path, last_id, ["word"])


def new_languages(names: Iterable[str], known: DataFrame) -> list[tuple[int, str, None]]:
    """Rows (id, name, tag) for language names that ``known`` lacks; tag stays null.

    Both sides are bounded by the number of registered rule sets.
    """
    present = {row.name: row.id for row in known.select("id", "name").collect()}
    fresh = sorted({name.lower() for name in names} - set(present))
    return [(n, name, None) for n, name in enumerate(fresh, max(present.values(), default=0) + 1)]
