"""Wikitext pages derived from the ``orders`` table.

The test tables hold no wikitext. These SQL expressions mean the same to Spark and to DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TITLE_SQL = """concat(
  CASE o_orderkey % 11
    WHEN 3 THEN 'User:' WHEN 5 THEN 'Template talk:' WHEN 7 THEN 'Category:' WHEN 9 THEN 'user:'
    ELSE '' END,
  'w', CAST(o_custkey AS STRING))"""

_A = "'w', CAST(o_custkey % 97 AS STRING)"
_B = "'w', CAST(o_custkey % 89 AS STRING)"
_FORM = "'{{nl-verb form of"
# Every combination of persons, one of them repeated, and none.
_PERSONS = """CASE o_orderkey % 9 WHEN 0 THEN '|p=1' WHEN 1 THEN '|p=2' WHEN 2 THEN '|p=3'
  WHEN 3 THEN '|p=12' WHEN 4 THEN '|p=13' WHEN 5 THEN '|p=23' WHEN 6 THEN '|p=123' WHEN 7 THEN '|p=11'
  ELSE '' END"""

TEXT_SQL = f"""concat(
  '{{{{also|x}}}}', chr(10), '==English==', chr(10), chr(10), '====Verb====', chr(10),
  '{{{{en-verb|a|b}}}}', chr(10), chr(10), '# To [[rest]].', chr(10),
  CASE WHEN o_orderkey % 5 = 4 THEN '== Dutch ==' ELSE '==Dutch==' END, chr(10), chr(10),
  '===Verb===', chr(10),
  CASE o_orderkey % 13
    WHEN 0 THEN '{{{{nl-verb}}}}'
    WHEN 1 THEN concat('{{{{nl-verb-form}}}}', chr(10), chr(10),
      '# ', {_FORM}|p=1|n=sg|t=pres|m=ind|', {_A}, '}}}}', chr(10),
      '# ', {_FORM}|p=23|n=sg|t=past|m=ind|', {_B}, '}}}}')
    WHEN 2 THEN concat('# ', {_FORM}|n=pl|t=past|m=ind|', {_A}, '}}}}')
    WHEN 3 THEN concat('# ', {_FORM}|n=sg|t=past|m=ind|', {_A}, '}}}} of {{{{l|nl|a}}}} b}}}}')
    WHEN 4 THEN concat('# ', {_FORM}|p=2|n=sg|m=imp|', {_A}, '}}}}')
    WHEN 5 THEN concat('# ', {_FORM}|p=2|n=sg|t=futu|m=ind|', {_A}, '}}}}')
    WHEN 6 THEN '{{{{nl-noun|f}}}}'
    WHEN 7 THEN concat('# ', {_FORM}|n=sg|m=ind|', {_A}, '}}}}')
    WHEN 8 THEN concat('# ', {_FORM}|t=pres|m=ind|', {_A}, '}}}}')
    WHEN 9 THEN '# {{{{nl-verb form of m=ind}}}}'
    WHEN 10 THEN concat('# ', {_FORM}', {_PERSONS}, '|n=sg|t=pres|m=ind|', {_B}, '}}}}')
    WHEN 11 THEN concat('# ', {_FORM}', {_PERSONS}, '|n=du|t=past|m=ind|', {_A}, '}}}}', chr(10), chr(10),
      '===Noun===', chr(10), chr(10), '===Verb===', chr(10), '# ', {_FORM}|n=pl|t=pres|m=ind|', {_B}, '}}}}')
    ELSE concat('# ', {_FORM}|n=pl|t=pres|m=ind|', {_A}, '}}}}', chr(10),
      '==Flemish==', chr(10), '===Verb===', chr(10), '# ', {_FORM}|n=pl|t=pres|m=ind|', {_B}, '}}}}') END,
  chr(10), chr(10), '====Noun====', chr(10), '{{{{nl-noun|n}}}}', chr(10),
  repeat(concat('* [[w', CAST(o_custkey AS STRING), ']] as a noun.', chr(10)), CAST(o_orderkey % 50 AS INT)),
  '==Stub==', chr(10))"""


def wikitext_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per order without its text: page_id, title."""
    return _orders(spark, sf_dir).selectExpr("o_orderkey AS page_id", f"{TITLE_SQL} AS title")


def wikitext_pages(spark: SparkSession, sf_dir: str, by_title: int | None = None) -> DataFrame:
    """One page per order: page_id, title, text; with ``by_title`` in so many partitions, which
    hold all pages of a title."""
    # As a generator each text is built once, not again in every filter on it.
    return _orders(spark, sf_dir, by_title).selectExpr(
        "o_orderkey AS page_id", f"{TITLE_SQL} AS title", f"explode(array({TEXT_SQL})) AS text"
    )


def _orders(spark: SparkSession, sf_dir: str, by_title: int | None = None) -> DataFrame:
    columns = "o_orderkey bigint, o_custkey bigint"
    orders = spark.read.schema(columns).parquet(f"{sf_dir}/orders.parquet")
    # A test table is a single file, which one task would read; the ids are few bytes a row.
    if by_title is not None:
        return orders.repartition(by_title, F.expr(TITLE_SQL))
    return orders.repartition(spark.sparkContext.defaultParallelism)


PAGES_SQL = f"SELECT o_orderkey AS page_id, {TITLE_SQL} AS title, {TEXT_SQL} AS text FROM orders"
