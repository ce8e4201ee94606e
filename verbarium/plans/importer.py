"""The batch import: pages in, dictionary and facts out."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from verbarium.functions import wikitext
from verbarium.operators.dictionary import new_languages, new_words, vocabulary
from verbarium.operators.extraction import templates
from verbarium.operators.facts import encode_facts, index_forms
from verbarium.operators.numbering import numbered
from verbarium.operators.pages import find_page, first_pages
from verbarium.operators.rules import RULES, RuleSet, by_lower_name, conjugate
from verbarium.schemas import CORRUPT as CORRUPT_TABLE
from verbarium.schemas import LANGUAGES
from verbarium.session import stage, work_folder
from verbarium.sources.dump import CORRUPT, corrupt_pages, good_pages, read_dump
from verbarium.sources.tables import Store, constant_rows


def decode_pages(
    pages: DataFrame, rules: Mapping[str, RuleSet] = RULES, page_limit: int = -1, path: str | None = None
) -> DataFrame:
    """Pages to decoded templates, rejected ones included; see ``first_pages`` for ``path``."""
    content = first_pages(pages, page_limit, path)
    return conjugate(templates(content, sorted(by_lower_name(rules))), rules)


def import_pages(
    store: Store,
    pages: DataFrame,
    rules: Mapping[str, RuleSet] = RULES,
    page_limit: int = -1,
    batch: int | None = None,
    corrupt: Callable[[], DataFrame] | None = None,
) -> int:
    """Add the verb forms of ``pages`` to the store as one batch; returns its number.

    One pass over the pages decodes the templates of all registered languages; the dictionary,
    the facts and the rejects derive from the decoded rows. ``corrupt``, which is asked once the
    pages are read, has the records of the broken ones, which are stored with the batch. A batch
    that broke off is repeated under its number. Naming the latest batch again replaces it; older
    ones are fixed, as later ones build on their ids. A batch shows up once all of it is written.
    """
    rules = by_lower_name(rules)
    last, last_word, last_fact = store.progress()
    if batch is None:
        batch = last + 1
    elif batch < last:
        raise ValueError(f"batch {batch} is older than the latest batch {last}")
    elif batch == last:
        _, last_word, last_fact = store.progress(before=batch)
        store.reopen(batch)

    spark = store.spark
    work = work_folder(spark, store.path)
    content = first_pages(pages, page_limit, f"{work}/page-ids")
    decoded = conjugate(templates(content, sorted(rules)), rules)
    decoded, last_fact = numbered(decoded, f"{work}/decoded", last_fact)

    fresh = constant_rows(spark, new_languages(rules, store.read("languages", batch)), LANGUAGES)
    broken = constant_rows(spark, [], CORRUPT_TABLE) if corrupt is None else corrupt()
    rejects = decoded.filter(F.col("status") != "ok")
    with ThreadPoolExecutor(1) as beside:
        # What nothing here waits for is written meanwhile.
        others = [("languages", fresh), ("rejects", rejects), ("corrupt", broken)]
        write_others = inheritable_thread_target(spark)(lambda: [store.write(*table, batch) for table in others])
        written = beside.submit(write_others)
        known = store.read("words", batch)
        fresh_words, last_word = new_words(vocabulary(decoded), known, f"{work}/words", last_word)
        store.write("words", fresh_words, batch)
        languages = store.read("languages", batch).unionByName(fresh)
        facts = encode_facts(decoded, known.unionByName(fresh_words), languages, store.tenses)
        # Files hold ranges, so a lookup of one infinitive opens few of them; a hot one is split.
        laid_out = facts.repartitionByRange("inf_id", "word_id").sortWithinPartitions("inf_id", "word_id")
        store.write("verb_forms", laid_out, batch)
        store.write("form_index", index_forms(store.read_batch("verb_forms", batch)), batch)
        written.result()
    store.finish(batch, last_word, last_fact)
    return batch


def import_decoded(
    store: Store,
    pages: DataFrame,
    rules: Mapping[str, RuleSet] = RULES,
    page_limit: int = -1,
    batch: int | None = None,
) -> int:
    """Import pages of a dump, broken ones included.

    Broken pages are counted while the others are imported, and looked for only if there are any.
    With a page limit, which needs several passes, the pages are staged first.
    """

    def records(pages: DataFrame) -> DataFrame:
        return corrupt_pages(pages).select(F.col(CORRUPT).alias("record"))

    if page_limit != -1:
        staged = stage(pages, f"{work_folder(store.spark, store.path)}/pages")
        return import_pages(store, good_pages(staged), rules, page_limit, batch, lambda: records(staged))
    seen = Observation()
    counted = pages.observe(seen, F.count_if(F.col(CORRUPT).isNotNull()).alias("broken"))
    return import_pages(
        store, good_pages(counted), rules, batch=batch, corrupt=lambda: records(pages if seen.get["broken"] else pages.limit(0))
    )


def import_dump(
    store: Store,
    path: str | list[str],
    rules: Mapping[str, RuleSet] = RULES,
    page_limit: int = -1,
    batch: int | None = None,
) -> int:
    """Import a dump file or folder. Without a page limit only pages with verbs are decoded."""
    containing = wikitext.VERB_MARK if page_limit == -1 else None
    return import_decoded(store, read_dump(store.spark, path, containing), rules, page_limit, batch)


def view_page(
    spark: SparkSession, path: str | list[str], title: str, early_stop: bool = False
) -> DataFrame:
    """The page of a dump with this title; see ``find_page``."""
    # Without characters that XML escapes, the title stands in the file as it is.
    containing = None if any(c in title for c in "&<>\"'") else title
    return find_page(good_pages(read_dump(spark, path, containing)), title, early_stop)
