"""Plans must hold at scale: no Python workers, no pairwise joins, pruned and filtered scans."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from verbarium.functions.wikitext import may_have_verb
from verbarium.plans import catalog
from verbarium.operators.rules import RULES
from verbarium.plans.importer import decode_pages
from verbarium.plans.wikitext_view import wikitext_pages
from verbarium.sources.dump import good_pages, read_dump

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def large_tables(spark):
    """Plans as they are when no table is small enough to broadcast by its size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# Queries whose only row-to-row joins are against one row or a fixed table.
@pytest.mark.parametrize("name", [query.__name__ for query in catalog.QUERIES])
def test_no_python_and_no_pairwise_join(spark, large_tables, name):
    plan = plan_of(getattr(catalog, name)(spark, SF_DIR))
    for operator in ["Python", "Pandas", "BroadcastNestedLoopJoin", "CartesianProduct"]:
        assert operator not in plan
    # Windows over a whole table appear only over one row per partition or per block of ids.
    if name not in ("page_limit", "word_dictionary"):
        assert not re.search(r"Window \(", plan)


@pytest.mark.parametrize(
    "name", ["all_words", "words_by_id", "infinitive_lookups", "lookup_missing", "admin_flag"]
)
def test_joins_of_unbounded_tables_are_not_broadcast(spark, large_tables, name):
    plan = plan_of(getattr(catalog, name)(spark, SF_DIR))
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan


def test_scans_read_only_what_is_needed(spark):
    plan = plan_of(catalog.namespace_filter(spark, SF_DIR))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    plan = plan_of(catalog.all_words(spark, SF_DIR))
    assert "ReadSchema: struct<word_id:bigint,lang_id:int,inf_id:bigint>" in plan
    plan = plan_of(catalog.word_by_id(spark, SF_DIR))
    assert "EqualTo(word_id,100)" in plan and "EqualTo(id,100)" in plan


def test_extraction_does_not_shuffle_and_decodes_each_page_once(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<page><title>a</title></page>")
    pages = good_pages(read_dump(spark, str(tmp_path), containing="===Verb==="))
    plan = plan_of(decode_pages(pages))
    assert "Exchange" not in plan
    assert plan.count("from_xml(") == 1
    assert re.search(r"\) Filter .*\n(?:.*\n)?Condition : .*Contains\(value#[0-9]+, ===Verb===\)", plan)


@pytest.mark.parametrize("name", ["morphology", "verb_forms", "reject_counts", "word_list", "rule_rows"])
def test_languages_share_one_scan_and_one_extraction(spark, name):
    """With two and three registered languages."""
    plan = plan_of(getattr(catalog, name)(spark, SF_DIR))
    tree = plan[: plan.index("(1) ")]
    assert tree.count("Scan parquet") == 1
    # The text, the sections, the templates and the decoded rows; the word list takes two words of a row.
    assert tree.count("Generate") == 4 + (name == "word_list")


def test_rule_sets_are_planned_once_for_the_languages_that_share_them(spark):
    languages = {f"language {n}": RULES["dutch"] for n in range(20)}
    pages = spark.createDataFrame([], "page_id long, title string, text string")
    plan = decode_pages(pages, languages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("m=(.{3})") == 1


@pytest.mark.parametrize("name", ["infinitive_lookups", "lookup_missing", "lookup_default"])
def test_lookups_filter_the_facts_before_they_aggregate(spark, large_tables, name):
    df = getattr(catalog, name)(spark, SF_DIR)
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    scans = [i for i, line in enumerate(plan) if "Relation" in line and "lang_id" in line]
    assert scans
    for i in scans:
        above = []
        level = depth(plan[i])
        for line in reversed(plan[:i]):
            if depth(line) < level:
                level = depth(line)
                above.append(line)
        kinds = [line for line in above if "Join" in line or "Aggregate" in line]
        assert "Join" in kinds[0]


def test_a_lookup_opens_few_fact_files(spark, store, make_pages):
    from tests.test_import import verb_page
    from verbarium.plans.importer import import_pages

    forms = [(n, f"w{n}", verb_page(f"{{{{nl-verb form of|n=pl|t=past|m=ind|i{n}}}}}")) for n in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        import_pages(store, make_pages(*forms))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for table, key in ((store.verb_forms, "inf_id"), (store.form_index, "word_id")):
        rows = table.selectExpr("input_file_name() AS file", key).groupBy("file")
        found = rows.agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()
        ranges = sorted((r["low"], r["high"]) for r in found)
        assert len(ranges) > 1
        assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


@pytest.mark.parametrize("name", ["word_by_id", "words_by_id", "infinitive_lookups", "lookup_missing", "all_words"])
def test_queries_by_form_read_the_index(spark, name):
    plan = plan_of(getattr(catalog, name)(spark, SF_DIR))
    assert "/form_index" in plan and "/verb_forms" not in plan


def test_a_table_of_one_verb_reads_by_constant_ids(spark):
    plan = plan_of(catalog.conjugation_of_word(spark, SF_DIR))
    assert re.search(r"PushedFilters: \[.*EqualTo\(inf_id,[0-9]+\)", plan) and "Subquery" not in plan


def test_constraints_read_and_count_every_table_once(spark, large_tables):
    df = catalog.constraint_report(spark, SF_DIR)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    final = final[final.index("Final Plan") : final.index("Initial Plan")]
    # One pass over each table, and one in which references and ids meet.
    for table in ("lineitem", "customer", "part", "nation"):
        assert final.count(f"/{table}.parquet") == 1
    assert len(re.findall(r"Exchange hashpartitioning\((?!constraint)", final)) == 6
    assert len(re.findall(r"Exchange hashpartitioning\(constraint", final)) == 1 and "Join" not in final


def test_pages_by_title_move_as_keys(spark):
    plain, dealt = wikitext_pages(spark, SF_DIR), wikitext_pages(spark, SF_DIR, by_title=3)
    # Below the shuffle no text is made.
    assert re.search(r"\) Exchange\nInput \[2\]: \[o_orderkey", plan_of(dealt))
    assert sorted(dealt.collect()) == sorted(plain.collect())
    places = dealt.select("title", F.spark_partition_id().alias("part")).distinct()
    assert places.groupBy("title").count().filter("count > 1").isEmpty()
    assert dealt.rdd.getNumPartitions() == 3


def test_headers_with_one_capital_are_found_without_lower_case(spark):
    texts = ["==Dutch==\n", "==DUTCH==\n", "==dutch==\n", "== Dutch ==\n", "==Dutch==", "==Éwé==\n", "==ÉWÉ==\n"]
    rows = spark.createDataFrame([(i, f"===Verb===\n{t}") for i, t in enumerate(texts)], "i int, text string")
    found = rows.filter(may_have_verb(F.col("text"), ["dutch", "éwé"]))
    assert [row["i"] for row in found.orderBy("i").collect()] == [0, 1, 2, 5, 6]
    condition = found._jdf.queryExecution().analyzed().toString()
    assert 0 < condition.index("==Dutch==") < condition.index("lower(")
