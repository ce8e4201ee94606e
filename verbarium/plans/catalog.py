"""The registered queries: each takes (session, folder of the test tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbarium.functions.inflection import SLOTS
from verbarium.operators import accounts, conjugation, extraction, facts, pages, quality, results
from verbarium.operators import words as word_queries
from verbarium.operators.dictionary import vocabulary
from verbarium.operators.rules import RULES
from verbarium.plans import kept, kept_counts
from verbarium.plans.importer import decode_pages, import_dump, import_pages
from verbarium.plans.wikitext_view import wikitext_pages, wikitext_titles
from verbarium.session import scratch_path
from verbarium.sources import dump, tables
from verbarium.sources.tables import Store
from verbarium.streaming.incremental import incremental_import
from verbarium.streaming.vocabulary import read_words, stream_words

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries; the comparison SQL uses the same.
PAGE_TITLE = "w42"
PAGE_LIMIT = 1000
WORD_ID = 100
WORD = "w45"
LANGUAGE_ID = 3
USER_ID = "7"
ADMIN_SEGMENT = "MACHINERY"

# Two languages that share rules, so that a form may belong to both.
REGISTRY = {"Dutch": RULES["dutch"], "flemish": RULES["dutch"]}
# Every such page of the dump of ``corrupt_pages`` is broken.
BROKEN_EVERY = 17
EARLY_TITLE = "page 7"
# The only infinitive of this word is itself, so the answer does not depend on the order of ids.
KEPT_WORD = "w45"
CDATA_EVERY = 19
# Pages of the dumps that have their text in a CDATA section, and the text that they have there.
CDATA_SQL = f"page_id % {CDATA_EVERY} = 0"
PAGE_END_SQL = "concat(text, '</page>', chr(10), '  <page><title>no page</title></page> end')"

_stores: dict[tuple[str, str], Store] = {}
_dumps: dict[tuple[str, str, str], str] = {}


def store_for(spark: SparkSession, sf_dir: str) -> Store:
    """The store imported from these tables, built on first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        store = Store(spark, scratch_path(spark, "store"))
        import_pages(store, wikitext_pages(spark, sf_dir), REGISTRY)
        _stores[key] = store
    return _stores[key]


def dump_for(spark: SparkSession, sf_dir: str, compression: str = "none") -> str:
    """XML dump files of the wikitext pages, written on first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, compression)
    if key not in _dumps:
        path = scratch_path(spark, "dump")
        dump.write_dump(wikitext_pages(spark, sf_dir), path, compression)
        _dumps[key] = path
    return _dumps[key]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Pages and extraction


def namespace_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.drop_special_pages(wikitext_titles(spark, sf_dir))


def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.find_page(wikitext_pages(spark, sf_dir), PAGE_TITLE)


def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page by its title, which no other page has, ending the scan where it is found."""
    titles = wikitext_titles(spark, sf_dir).selectExpr("page_id", "concat('page ', page_id) AS title")
    return pages.find_page(titles, EARLY_TITLE, early_stop=True)


def page_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.first_pages(wikitext_titles(spark, sf_dir), PAGE_LIMIT)


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.drop_special_pages(wikitext_pages(spark, sf_dir))


def language_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.language_sections(_content(spark, sf_dir))


def verb_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.verb_sections(_content(spark, sf_dir))


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.templates(_content(spark, sf_dir))


def supported_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.templates(_content(spark, sf_dir), ["dutch"])


def morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_pages(wikitext_pages(spark, sf_dir), REGISTRY)


def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.status_counts(decode_pages(wikitext_pages(spark, sf_dir), REGISTRY))


def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_for(spark, sf_dir).rejects


def verb_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.text_forms(decode_pages(wikitext_pages(spark, sf_dir), REGISTRY))


def _row(infinitive: Column, tense: str) -> Column:
    """A singular form for the rule sets below."""
    none = F.lit(None).cast("int").alias("person")
    return F.struct(F.lit("ok").alias("status"), infinitive.alias("infinitive"), F.lit(tense).alias("tense"), F.lit(1).alias("num"), none)


def rule_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two registered languages; the second only keeps its templates as they are."""

    def verbatim(title: Column, template: Column) -> Column:
        return F.array(_row(title, "present"))

    decoded = decode_pages(wikitext_pages(spark, sf_dir), {"english": verbatim, **RULES})
    return decoded.groupBy("language", "status").agg(F.count("*").alias("n"))


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of three languages in one pass, one of which gives no row or two for a template."""

    def both_tenses(title: Column, template: Column) -> Column:
        return F.when(~title.contains(":"), F.array(_row(title, "present"), _row(template, "past")))

    decoded = decode_pages(wikitext_pages(spark, sf_dir), {"English": both_tenses, **REGISTRY})
    return decoded.select("page_id", "section", "language", "pos", "status", "infinitive", "tense", "num")


# Dictionary and facts


def word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(decode_pages(wikitext_pages(spark, sf_dir), REGISTRY))


def word_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_for(spark, sf_dir).words


def language_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_for(spark, sf_dir).languages.select("id", "name")


def encoded_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_for(spark, sf_dir).verb_forms.drop("id")


def fact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = store_for(spark, sf_dir).verb_forms.groupBy("id").agg(F.count("*").alias("n"))
    return ids.agg(
        F.count("*").alias("n_ids"),
        F.max("n").alias("most_rows_per_id"),
        F.count_if(F.col("id").isNull()).alias("n_missing"),
    )


def forms_by_tense(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = store_for(spark, sf_dir)
    names = F.broadcast(store.tenses.select(F.col("id").alias("tense_id"), "tense"))
    counts = store.verb_forms.groupBy("tense_id", "num").agg(F.count("*").alias("n"))
    return counts.join(names, "tense_id").select("tense", "num", "n")


# Words


def all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = store_for(spark, sf_dir)
    return word_queries.all_words(store.form_index, store.words)


def word_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = store_for(spark, sf_dir)
    return word_queries.word_by_id(store.form_index, store.words, WORD_ID)


def words_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = store_for(spark, sf_dir)
    return word_queries.words_by_id(store.form_index, store.words)


def infinitive_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = store_for(spark, sf_dir)
    return word_queries.infinitive_of(store.form_index, store.words, WORD)


def _lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup per customer: some blank, some of words that do not exist."""
    return _table(spark, sf_dir, "customer").selectExpr("c_custkey AS lookup_id", LOOKUP_SQL)


LOOKUP_SQL = """CASE c_mktsegment WHEN 'BUILDING' THEN '' WHEN 'FURNITURE'
  THEN concat('x', CAST(c_custkey AS STRING)) ELSE concat('w', CAST(c_custkey AS STRING))
  END AS word"""


def infinitive_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = store_for(spark, sf_dir)
    return word_queries.look_up_infinitives(
        _lookups(spark, sf_dir), store.form_index, store.words
    ).select("lookup_id", "word", "infinitive", "inf_id")


def lookup_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = store_for(spark, sf_dir)
    return word_queries.missing_words(
        _lookups(spark, sf_dir), store.form_index, store.words
    ).select("lookup_id", "word", "error")


# Conjugation tables


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = store_for(spark, sf_dir)
    return conjugation.conjugation_tables(store.verb_forms, store.words)


def _slots_as_text(tables_: DataFrame, keep: list[str]) -> DataFrame:
    return tables_.select(
        *keep,
        *[
            F.array_join(F.col(f"{tense}.{slot}"), ",").alias(f"{tense}_{slot}".lower())
            for tense in conjugation.TENSE_FIELDS
            for slot in SLOTS
        ],
    )


def conjugation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables_ = _tables(spark, sf_dir).withColumnRenamed("Infinitive", "infinitive")
    return _slots_as_text(tables_, ["inf_id", "infinitive"])


def conjugation_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = store_for(spark, sf_dir)
    return conjugation.conjugation_slots(store.verb_forms, store.words)


def conjugation_of_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = store_for(spark, sf_dir)
    found = conjugation.conjugation_table(store.verb_forms, store.words, WORD, store.form_index)
    return _slots_as_text(found.withColumnRenamed("Infinitive", "infinitive"), ["infinitive"])


def conjugation_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = conjugation.flat_tables(_tables(spark, sf_dir))
    return flat.select(
        F.col("Infinitive").alias("infinitive"),
        "label",
        F.col("Present").alias("present"),
        F.col("Past").alias("past"),
    )


def conjugation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.as_json(_tables(spark, sf_dir), keep=["inf_id"])


def person_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = store_for(spark, sf_dir)
    return conjugation.person_slots(store.verb_forms).select(
        "word_id", "inf_id", "tense_id", "num", "person", "slot"
    )


def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = store_for(spark, sf_dir)
    asked = _table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS lookup_id",
        "CASE n_regionkey WHEN 1 THEN '' WHEN 2 THEN n_name"
        " ELSE concat('w', CAST(n_nationkey AS STRING)) END AS word",
    )
    found = conjugation.look_up_tables(asked, store.verb_forms, store.words, store.form_index)
    found = found.withColumnRenamed("Infinitive", "infinitive")
    return _slots_as_text(found, ["lookup_id", "word", "infinitive"])


# Languages, users and data quality


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS id", "lower(n_name) AS name", "substr(n_name, 8) AS tag"
    )


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir)


def language_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.by_id(_languages(spark, sf_dir), LANGUAGE_ID)


def languages_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.as_json(_languages(spark, sf_dir))


def words_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.as_json(all_words(spark, sf_dir))


USER_SQL = [
    "CAST(c_custkey AS STRING) AS id",
    f"CASE WHEN c_mktsegment = '{ADMIN_SEGMENT}' THEN 1 ELSE 2 END AS role_id",
    "c_name AS name",
    "c_nationkey AS target_language_id",
]


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users, created on the day of their first order."""
    first = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").alias("created_at")
    )
    customers = _table(spark, sf_dir, "customer").join(first, "c_custkey", "left")
    return customers.selectExpr(*USER_SQL, "created_at")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.public_users(_users(spark, sf_dir))


def users_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.as_json(results.documented_users(_users(spark, sf_dir)))


def user_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.user_by_id(_users(spark, sf_dir), USER_ID)


def admin_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asks for every other customer key and beyond, so that half are unknown."""
    asked = _table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey * 2 AS STRING) AS id")
    return accounts.admin_flags(asked, _users(spark, sf_dir), tables.roles(spark))


REQUEST_SQL = """CASE WHEN o_orderkey % 89 = 7 THEN NULL WHEN o_orderpriority = '5-LOW'
  THEN concat('Customer#', lpad(CAST(o_custkey AS STRING), 9, '0'))
  ELSE concat('new#', CAST(o_custkey AS STRING)) END AS name"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return orders.selectExpr("o_orderkey AS request_id", REQUEST_SQL)


def new_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = accounts.new_accounts(
        _requests(spark, sf_dir), _users(spark, sf_dir), tables.roles(spark)
    )
    return made.select("name", "role_id", "target_language_id")


def rejected_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.rejected_requests(_requests(spark, sf_dir), _users(spark, sf_dir))


def uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return quality.duplicate_keys(orders, "orders", "o_custkey")


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = _table(spark, sf_dir, "supplier")
    orders = _table(spark, sf_dir, "orders")
    return quality.orphans(orders, "orders", "o_custkey", suppliers, "s_suppkey")


def null_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode_pages(wikitext_pages(spark, sf_dir), REGISTRY)
    return quality.null_violations(
        decoded, "decoded", ["title", "template", "infinitive", "tense", "num", "person"]
    )


# Rows that break constraints, derived from all rows of the tables.
BAD_USER_SQL = [
    "CASE WHEN c_custkey % 31 = 3 THEN NULL WHEN c_custkey % 29 = 5 THEN '5' ELSE CAST(c_custkey AS STRING) END AS id",
    "CASE WHEN c_custkey % 23 = 2 THEN NULL WHEN c_custkey % 19 = 1 THEN 7 ELSE 2 END AS role_id",
    "CASE WHEN c_custkey % 37 = 4 THEN NULL ELSE concat('name', CAST(c_custkey % 700 AS STRING)) END AS name",
    "c_nationkey AS target_language_id",
]
BAD_FORM_SQL = [
    "l_orderkey AS id",
    "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linenumber END AS lang_id",
    "CAST(l_partkey AS BIGINT) AS word_id",
    "CAST(l_suppkey AS BIGINT) AS inf_id",
    "l_linenumber AS tense_id",
    "CASE WHEN l_returnflag = 'R' THEN NULL ELSE 1 END AS num",
]
BAD_WORD_SQL = [
    "CASE WHEN p_partkey % 41 = 6 THEN NULL ELSE CAST(p_partkey AS BIGINT) END AS id",
    "p_name AS word",
]


def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All constraints over tables in which nulls, repeats and lost references occur."""
    users_ = _table(spark, sf_dir, "customer").selectExpr(*BAD_USER_SQL, "current_timestamp() AS created_at")
    return quality.violations(
        {
            "languages": _languages(spark, sf_dir),
            "words": _table(spark, sf_dir, "part").selectExpr(*BAD_WORD_SQL),
            "tenses": tables.tenses(spark),
            "roles": tables.roles(spark),
            "verb_forms": _table(spark, sf_dir, "lineitem").selectExpr(*BAD_FORM_SQL),
            "users": users_,
        }
    )


def store_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the imported store; only the users' languages, which it lacks, are missing."""
    store = store_for(spark, sf_dir)
    return quality.violations(
        {
            "languages": store.languages,
            "words": store.words,
            "tenses": store.tenses,
            "roles": store.roles,
            "verb_forms": store.verb_forms,
            "users": _users(spark, sf_dir),
        }
    )


def empty_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any word, and any word of a language that nobody imported, exists."""
    found = all_words(spark, sf_dir)
    none = results.none_exist(found, "words")
    return none.unionByName(results.none_exist(found.filter("language = 99"), "words in 99"))


# Dumps


def _with_page_ends(spark: SparkSession, sf_dir: str, by_title: int | None = None) -> DataFrame:
    """The pages, some with a page end and a page as the end of their text."""
    text = F.expr(f"CASE WHEN {CDATA_SQL} THEN {PAGE_END_SQL} ELSE text END")
    return wikitext_pages(spark, sf_dir, by_title).withColumn("text", text)


def dump_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dump.good_pages(dump.read_dump(spark, dump_for(spark, sf_dir)))


def dump_scan_bz2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dump.good_pages(dump.read_dump(spark, dump_for(spark, sf_dir, "bzip2")))


def corrupt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broken pages that an import of a dump has stored, by the id in their raw text."""
    key = (spark.sparkContext.applicationId, f"broken {sf_dir}")
    if key not in _stores:
        store = Store(spark, scratch_path(spark, "broken-store"))
        path = scratch_path(spark, "broken-dump")
        xml = dump.page_xml(wikitext_pages(spark, sf_dir))
        broken = F.replace("value", F.lit("</text>"), F.lit("</txt>"))
        lines = xml.select(F.when(F.col("page_id") % BROKEN_EVERY == 0, broken).otherwise(F.col("value")).alias("value"))
        lines.write.text(path)
        import_dump(store, path, REGISTRY)
        _stores[key] = store
    found = F.regexp_extract("record", "<id>([0-9]+)</id>", 1).cast("long")
    return _stores[key].corrupt.select(found.alias("page_id"))


def _streamed(spark: SparkSession, sf_dir: str) -> Store:
    """A store after a streamed import of a dump in three micro-batches that keeps the tables."""
    key = (spark.sparkContext.applicationId, f"stream {sf_dir}")
    if key not in _stores:
        store = Store(spark, scratch_path(spark, "stream-store"))
        checkpoint = scratch_path(spark, "stream-checkpoint")
        # Several batches, so that later ones meet words that earlier ones brought. Every
        # CDATA_EVERY-th page has its text in a CDATA section, with a page end in it. A packed file
        # is read by one task, so a batch has one for each.
        path = scratch_path(spark, "arrivals")
        files = spark.sparkContext.defaultParallelism
        # The keys move, the texts are made where they are written.
        pages_ = _with_page_ends(spark, sf_dir, by_title=3 * files)
        dump.page_xml(pages_, F.expr(CDATA_SQL)).select("value").write.text(path, compression="gzip")
        incremental_import(store, path, checkpoint, REGISTRY, max_files=files, keep_tables=True, keep_counts=True).awaitTermination()
        _stores[key] = store
    return _stores[key]


def streamed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of dump files that arrive before two runs of a stream, each at its first sight."""
    key = (spark.sparkContext.applicationId, f"words {sf_dir}", "none")
    if key not in _dumps:
        arrivals, out, checkpoint = (scratch_path(spark, f"words-{part}") for part in ("in", "out", "checkpoint"))
        for run in range(2):
            # Both have pages of most titles.
            pages_ = wikitext_pages(spark, sf_dir).filter(F.col("page_id") % 2 == run)
            dump.page_xml(pages_).select("value").coalesce(2).write.mode("append").text(arrivals)
            stream_words(spark, arrivals, out, checkpoint, REGISTRY).awaitTermination()
        _dumps[key] = out
    return read_words(spark, _dumps[key])


def incremental_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and infinitives after a streamed import."""
    store = _streamed(spark, sf_dir)
    form = store.words.select(F.col("id").alias("word_id"), "word")
    inf = store.words.select(F.col("id").alias("inf_id"), F.col("word").alias("infinitive"))
    return (
        store.verb_forms.join(form, "word_id")
        .join(inf, "inf_id")
        .select("word", "infinitive", "tense_id", "num", "person")
    )


def kept_conjugation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that a streamed import has kept up to date, batch by batch."""
    tables_ = kept.kept_tables(_streamed(spark, sf_dir)).withColumnRenamed("Infinitive", "infinitive")
    return _slots_as_text(tables_, ["infinitive"])


def kept_table_of_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kept.kept_table(_streamed(spark, sf_dir), KEPT_WORD)
    return _slots_as_text(found.withColumnRenamed("Infinitive", "infinitive"), ["infinitive"])


def kept_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on the streamed store, from the counts that every batch has added."""
    store = _streamed(spark, sf_dir)
    others = {"tenses": store.tenses, "roles": store.roles, "users": _users(spark, sf_dir)}
    return kept_counts.kept_violations(store, others)


def dump_cdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump with texts in CDATA sections that hold page ends and whole pages."""
    path = scratch_path(spark, "cdata-dump")
    dump.page_xml(_with_page_ends(spark, sf_dir), F.expr(CDATA_SQL)).select("value").write.text(path, compression="gzip")
    return dump.good_pages(dump.read_dump(spark, path))


QUERIES: list[Query] = [
    namespace_filter,
    page_lookup,
    early_stop,
    page_limit,
    language_sections,
    verb_sections,
    templates,
    supported_templates,
    morphology,
    reject_counts,
    rejects,
    verb_forms,
    rule_registry,
    rule_rows,
    word_list,
    word_dictionary,
    language_dictionary,
    encoded_facts,
    fact_ids,
    forms_by_tense,
    all_words,
    word_by_id,
    words_by_id,
    infinitive_of,
    infinitive_lookups,
    lookup_missing,
    conjugation_table,
    conjugation_slots,
    conjugation_of_word,
    conjugation_flat,
    conjugation_json,
    person_slots,
    lookup_default,
    languages,
    languages_json,
    words_json,
    language_by_id,
    users,
    users_json,
    user_by_id,
    admin_flag,
    new_accounts,
    rejected_accounts,
    uniqueness,
    orphans,
    null_violations,
    constraint_report,
    store_constraints,
    kept_constraints,
    empty_result,
    dump_scan,
    dump_scan_bz2,
    dump_cdata,
    corrupt_pages,
    incremental_forms,
    streamed_words,
    kept_conjugation_tables,
    kept_table_of_word,
]
