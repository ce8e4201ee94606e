from __future__ import annotations

import bz2
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from verbarium.plans.importer import view_page
from verbarium.sources.dump import (
    _well_formed,
    corrupt_pages,
    dump_chunks,
    good_pages,
    mark_before,
    page_xml,
    pages_of,
    read_dump,
    whole_chunks,
    write_dump,
)

HEAD = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/" version="0.10">
  <siteinfo><sitename>Some wiki</sitename>
    <namespaces><namespace key="0" /><namespace key="1">Talk</namespace></namespaces>
  </siteinfo>
"""
TAIL = "</mediawiki>\n"


def page(number: int, title: str, revisions: str) -> str:
    return (
        f"  <page>\n    <title>{title}</title>\n    <ns>0</ns>\n    <id>{number}</id>\n"
        f"{revisions}  </page>\n"
    )


def revision(text: str) -> str:
    return (
        "    <revision>\n      <id>9</id>\n      <timestamp>2020-01-01T00:00:00Z</timestamp>\n"
        "      <contributor><username>someone</username><id>5</id></contributor>\n"
        f'      <model>wikitext</model>\n      <text xml:space="preserve">{text}</text>\n'
        "      <sha1>abc</sha1>\n    </revision>\n"
    )


def dump_of(*pages: str) -> str:
    return HEAD + "".join(pages) + TAIL


def test_reads_id_title_and_exact_text(spark, tmp_path):
    path = tmp_path / "d.xml"
    path.write_text(
        dump_of(
            page(1, "one", revision("  text &lt;b&gt; &amp;amp; &quot;x&quot;\n\n  end ")),
            page(2, "&amp;two", revision("Größe x")),
        )
    )
    got = rows_of(good_pages(read_dump(spark, str(path))))
    assert got == [
        (1, "one", '  text <b> &amp; "x"\n\n  end '),
        (2, "&two", "Größe x"),
    ]


def test_missing_and_repeated_elements(spark, tmp_path):
    path = tmp_path / "d.xml"
    path.write_text(
        dump_of(
            page(1, "empty", "    <revision><text/></revision>\n"),
            page(2, "no revision", ""),
            page(3, "two", revision("old") + revision("new")),
        )
    )
    got = rows_of(good_pages(read_dump(spark, str(path))))
    assert got == [(1, "empty", ""), (2, "no revision", ""), (3, "two", "new")]


def test_broken_pages_are_set_aside_and_others_survive(spark, tmp_path):
    path = tmp_path / "d.xml"
    cut_off = "  <page>\n    <title>cut</title>\n    <id>4</id>\n    <revision><text>half"
    path.write_text(
        HEAD
        + page(1, "a", revision("x"))
        + page(2, "b", "<revision><text>y</txt></revision>\n")
        + page(3, "c", revision("z"))
        + cut_off
    )
    pages = read_dump(spark, str(path))
    assert [row[0] for row in rows_of(good_pages(pages))] == [1, 3]
    broken = [row[0] for row in rows_of(corrupt_pages(pages))]
    assert len(broken) == 2
    assert any("<title>b</title>" in text for text in broken)
    assert any("<title>cut</title>" in text for text in broken)


def test_page_with_attributes_and_similar_element_names(spark, tmp_path):
    path = tmp_path / "d.xml"
    body = page(1, "a", revision("x")).replace("<page>", '<page kind="k">')
    path.write_text(HEAD + "<pages>2</pages>" + body + TAIL)
    assert rows_of(good_pages(read_dump(spark, str(path)))) == [(1, "a", "x")]


@pytest.mark.parametrize("compression", [None, "bzip2"])
def test_many_partitions_lose_and_repeat_nothing(spark, tmp_path, compression):
    path = tmp_path / ("d.xml.bz2" if compression else "d.xml")
    rng = random.Random(7)
    # Hardly compressible, so that the bz2 file has many blocks.
    texts = {n: "%x" % rng.getrandbits(4000 * (n % 7) + 4) for n in range(500)}
    data = dump_of(*[page(n, f"w{n}", revision(text)) for n, text in texts.items()]).encode()
    path.write_bytes(bz2.compress(data, 1) if compression else data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000" if compression else "100000")
    try:
        pages = good_pages(read_dump(spark, str(path)))
        assert pages.rdd.getNumPartitions() > 4
        got = rows_of(pages)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(((n, f"w{n}", text) for n, text in texts.items()), key=repr)


def test_containing_spares_other_pages_but_not_respelled_ones(spark, tmp_path):
    path = tmp_path / "d.xml"
    path.write_text(
        dump_of(
            page(1, "a", revision("===Verb===")),
            page(2, "b", revision("nothing")),
            page(3, "c", revision("&#61;==Verb===")),
        )
    )
    got = rows_of(good_pages(read_dump(spark, str(path), containing="===Verb===")))
    assert got == [(1, "a", "===Verb==="), (3, "c", "===Verb===")]


def test_written_dump_reads_back(spark, tmp_path, make_pages):
    pages = make_pages((1, 'a<b> & "c"', "x\n</page> ]]> &amp; '"), (2, "plain", ""))
    for compression in [None, "bzip2"]:
        path = str(tmp_path / f"out-{compression}")
        write_dump(pages, path, compression)
        assert rows_of(good_pages(read_dump(spark, path))) == rows_of(pages)


def cdata(text: str) -> str:
    return f"    <revision><text><![CDATA[{text}]]></text></revision>\n"


def test_page_ends_inside_cdata_end_no_page(spark, tmp_path):
    path = tmp_path / "d.xml"
    fake = "x </page>\n  <page><title>fake</title><id>9</id>\n</page> y </page></page>"
    path.write_text(
        dump_of(
            page(1, "a", cdata("a </page> b")),
            page(2, "b", revision("x")),
            page(3, "c", cdata(fake)),
            page(4, "d", cdata("one section") + cdata("two </page> ]] >")),
            page(5, "e", cdata("]]]]><![CDATA[></page>===Verb===")),
        )
    )
    expected = [(1, "a", "a </page> b"), (2, "b", "x"), (3, "c", fake), (4, "d", "two </page> ]] >"), (5, "e", "]]></page>===Verb===")]
    pages = read_dump(spark, str(path))
    assert rows_of(good_pages(pages)) == expected
    assert rows_of(corrupt_pages(pages)) == []
    assert rows_of(good_pages(read_dump(spark, str(path), containing="===Verb==="))) == expected[4:]


def test_section_that_never_ends_breaks_its_own_page_only(spark, tmp_path):
    path = tmp_path / "d.xml"
    path.write_text(
        dump_of(
            page(1, "a", cdata("a </page> b")),
            page(2, "b", "    <revision><text><![CDATA[open</text></revision>\n"),
            page(3, "c", revision("x")),
        )
    )
    pages = read_dump(spark, str(path))
    assert rows_of(good_pages(pages)) == [(1, "a", "a </page> b"), (3, "c", "x")]
    assert ["<title>b</title>" in row[0] for row in rows_of(corrupt_pages(pages))] == [True]


@pytest.mark.parametrize("compression", [None, "bzip2"])
def test_cut_pages_over_many_blocks_and_files(spark, tmp_path, compression):
    """Sections go over the borders of blocks; each file stands for itself."""
    rng = random.Random(11)
    (tmp_path / "in").mkdir()
    expected = []
    for name in "abc":
        pages = []
        for n in range(120):
            number, text = len(expected), "%x" % rng.getrandbits(4000 * (n % 5) + 4)
            if n % 7 == 0 and name != "b":
                text = " </page> ".join(text[i : i + 300] for i in range(0, len(text), 300)) + "</page>"
                pages.append(page(number, f"w{number}", cdata(text)))
            else:
                pages.append(page(number, f"w{number}", revision(text)))
            expected.append((number, f"w{number}", text))
        data = dump_of(*pages).encode()
        path = tmp_path / "in" / (f"{name}.xml.bz2" if compression else f"{name}.xml")
        path.write_bytes(bz2.compress(data, 1) if compression else data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = rows_of(good_pages(read_dump(spark, str(tmp_path / "in"))))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(expected, key=repr)


def test_written_cdata_reads_back(spark, tmp_path, make_pages):
    pages = make_pages((1, "a", "x </page> ]]> <page> &amp; ]]"), (2, "b", "y"), (3, "c", "<![CDATA[ z </page>"))
    page_xml(pages, F.col("page_id") != 2).select("value").write.text(str(tmp_path / "out"))
    assert rows_of(good_pages(read_dump(spark, str(tmp_path / "out")))) == rows_of(pages)


BROKEN = {
    "wrong end": revision("x").replace("</text>", "</txt>"),
    "unknown entity": revision("x &nbsp; y"),
    "bare ampersand": revision("x & y"),
    "bare angle": revision("x < y"),
    "not closed": revision("x").replace("</model>", ""),
    "control character": revision("x \x02 y"),
    "two attributes": revision("x").replace("<text ", '<text bytes="1" bytes="2" '),
    "crossing": "    <revision><text>x</revision></text>\n",
}


def test_broken_pages_without_the_searched_string_are_reported(spark, tmp_path):
    path = tmp_path / "d.xml"
    whole = [revision("x &lt;b&gt; &amp;nbsp; é"), "", "    <revision><text/></revision>\n", revision("x").replace("<text ", '<text bytes="1" ')]
    path.write_text(
        dump_of(
            *[page(n, name, text) for n, (name, text) in enumerate(BROKEN.items())],
            page(50, "bad id", revision("x")).replace("<id>50</id>", "<id>fifty</id>"),
            *[page(100 + n, "whole", text) for n, text in enumerate(whole)],
            page(200, "verb", revision("===Verb===")),
        )
    )
    pages = read_dump(spark, str(path), containing="===Verb===")
    assert rows_of(good_pages(pages)) == [(200, "verb", "===Verb===")]
    titles = [re.search("<title>(.*)</title>", row[0])[1] for row in rows_of(corrupt_pages(pages))]
    assert sorted(titles) == sorted([*BROKEN, "bad id"])
    # The test is as strict as the decoder, and spares the whole pages from it.
    every = read_dump(spark, str(path))
    assert rows_of(corrupt_pages(every)) == rows_of(corrupt_pages(pages))
    chunks = dump_chunks(spark, str(path)).filter("value LIKE '%<title>whole%'")
    assert {row[0] for row in chunks.select(_well_formed(F.col("value"))).collect()} == {True}


def test_several_paths(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"{n}.xml").write_text(dump_of(page(n, f"p{n}", revision("x"))))
    paths = [str(tmp_path / "1.xml"), str(tmp_path / "2.xml")]
    assert len(rows_of(read_dump(spark, paths))) == 2


@pytest.mark.parametrize("early_stop", [False, True])
def test_view_page(spark, tmp_path, early_stop):
    path = tmp_path / "d.xml"
    path.write_text(
        dump_of(
            page(1, "User:x", revision("hidden")),
            page(2, "a &amp; b", revision("found")),
            page(3, "plain", revision("plain text")),
        )
    )

    def view(title):
        return rows_of(view_page(spark, str(path), title, early_stop))

    assert view("a & b") == [(2, "a & b", "found")]
    assert view("plain") == [(3, "plain", "plain text")]
    assert view("User:x") == []
    assert view("Plain") == []


def test_only_the_chunks_of_cut_pages_are_moved(spark, tmp_path):
    """However large the keys of the cut pages are: nothing but their own chunks is joined."""
    pages = [page(n, f"w{n}", cdata("a </page> </page> b") if n % 4 == 0 else revision("x")) for n in range(200)]
    path = tmp_path / "d.xml"
    path.write_text(dump_of(*pages))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = whole_chunks(dump_chunks(spark, str(path)))
        whole.collect()
        plan = whole._jdf.queryExecution().executedPlan().toString()
        got = rows_of(good_pages(read_dump(spark, str(path))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == sorted([(n, f"w{n}", "a </page> </page> b" if n % 4 == 0 else "x") for n in range(200)], key=repr)
    # Every shuffled join, whose sides are sorted, stands above the filter on what lies in a section.
    plan = plan.split("== Initial Plan ==")[0]
    for side in plan.split("SortMergeJoin")[1:]:
        assert "seen" in side


@pytest.mark.parametrize("batch", [1, 3, 100])
def test_marks_are_carried_along_in_a_block(spark, batch):
    marks = [None, True, None, None, False, None, None, None, True, None, None]
    keys = [1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3]
    expected = [None, None, True, True, True, False, None, None, None, True, None]
    rows = spark.createDataFrame(list(zip(range(11), keys, marks)), "n int, key long, mark boolean").coalesce(1)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = rows.sortWithinPartitions("n").select("n", mark_before()(F.col("mark"), F.col("key")).alias("seen")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert [row["seen"] for row in sorted(got)] == expected


def test_pages_that_start_plainly_need_no_regex(spark):
    parts = ["\n  <page>\n<id>1</id> <page > ", "<page>\r\n<id>2</id>", "\t<page><id>3</id>", "\n<page x='<page>'><id>4</id>",
             "<head/>\n<page><id>5</id>", "</mediawiki>\n", " \n", "rest of <pages> "]
    chunks = spark.createDataFrame([(part,) for part in parts], "value string")
    pages = pages_of(chunks)
    good = sorted(row["page_id"] for row in good_pages(pages).collect())
    broken = sorted(row[0] for row in corrupt_pages(pages).collect())
    assert good == [2, 3, 5]
    # As before, from the page's start on.
    assert broken == sorted([parts[0].strip("\n ") + " </page>", "<page x='<page>'><id>4</id></page>", "rest of <pages> </page>"])
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith" in plan or "startswith" in plan.lower()
