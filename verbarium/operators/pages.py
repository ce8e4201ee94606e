"""Page-level operators: namespace filter, title lookup, page limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbarium.functions import wikitext
from verbarium.operators.numbering import number_rows
from verbarium.session import scratch_path, stage

# Counts per round of a selection.
CELLS = 1 << 14


def drop_special_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(~wikitext.is_special(F.col("title")))


def find_page(pages: DataFrame, title: str, early_stop: bool = False) -> DataFrame:
    """The page with exactly this title; special pages are never found.

    Several pages may share a title: the lowest page id wins. ``early_stop`` takes whichever
    comes up first and scans no further than it must.
    """
    hits = drop_special_pages(pages).filter(F.col("title") == title)
    return hits.limit(1) if early_stop else hits.orderBy("page_id").limit(1)


def first_pages(pages: DataFrame, limit: int = -1, path: str | None = None) -> DataFrame:
    """The first ``limit`` non-special pages by page id, or all of them for -1.

    Pages with the same id go by title, those without an id come last. Rows that repeat both
    id and title are one page, and all of them are returned. The last id is selected by counts
    (``nth_id``), so nothing is sorted but the titles that share it, and the texts are read once
    and not moved at all. ``path``, or a new place in the scratch area, takes what is staged.
    """
    if limit == 0 or limit < -1:
        raise ValueError("limit must be -1 or at least 1")
    content = drop_special_pages(pages)
    if limit == -1:
        return content
    path = path or scratch_path(pages.sparkSession, "page-ids")
    keys = content.select("page_id", "title")
    found = nth_id(keys, limit)
    if found:
        most, titles = _copies(keys, found[0])
        if most > 1:
            # Counted once each, the pages reach further.
            keys = stage(keys.distinct(), f"{path}/keys")
            found = nth_id(keys, limit)
            titles = _copies(keys, found[0])[1] if found else 0
    if not found:
        return content
    last, before = found
    if titles <= limit - before:
        return content.filter(_upto(last))
    here = F.col("page_id").eqNullSafe(F.lit(last))
    shared = keys.filter(here).select("title").distinct()
    numbered = number_rows(shared, f"{path}/titles", order=["title"])
    last_title = numbered.filter(F.col("id") == limit - before).select("title").scalar()
    return content.filter(_upto(last) & (~here | (F.col("title") <= last_title)))


def _upto(last: int | None) -> Column:
    """Rows up to this id; those without an id come after all others."""
    return F.lit(True) if last is None else F.col("page_id") <= last


def _copies(keys: DataFrame, last: int | None) -> tuple[int, int]:
    """How often the most frequent page up to ``last`` occurs, and the number of titles of ``last``."""
    counts = keys.filter(_upto(last)).groupBy("page_id", "title").count()
    return tuple(counts.agg(F.max("count"), F.count_if(F.col("page_id").eqNullSafe(F.lit(last)))).first())


def nth_id(keys: DataFrame, n: int) -> tuple[int | None, int] | None:
    """The ``page_id`` of the n-th row by id, None for a row without one, and the number of rows
    with lower ids; None if there are at most ``n`` rows.

    Each round counts the rows of the range by at most ``CELLS`` cells of equal width and goes
    on in the cell where the n-th one is. Only the counts reach the driver.
    """
    ids = keys.select("page_id")
    low, high, known, rows = ids.agg(F.min("page_id"), F.max("page_id"), F.count("page_id"), F.count("*")).first()
    if rows <= n:
        return None
    if known < n:
        return None, known
    before = 0
    while low < high:
        shift = 0
        while (high >> shift) - (low >> shift) >= CELLS:
            shift += 1
        cells = ids.filter(F.col("page_id").between(low, high)).groupBy(F.shiftright("page_id", shift).alias("cell")).count()
        for cell, count in sorted(map(tuple, cells.collect())):
            if before + count >= n:
                break
            before += count
        low, high = max(low, cell << shift), min(high, ((cell + 1) << shift) - 1)
    return low, before
