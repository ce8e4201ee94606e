from __future__ import annotations

import bz2

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tests.conftest import rows_of
from tests.test_dump import cdata, dump_of, page, revision
from verbarium.sources.bz2_files import UNFINISHED, Bz2Writer, Written, mounted_folder, write_lines
from verbarium.sources.dump import corrupt_pages, good_pages, read_dump, write_dump


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_bz2_dumps_are_packed_in_small_blocks(spark, tmp_path, make_pages, scheme):
    pages = make_pages(*[(n, f"w{n}", f"text {n} </page> & \n") for n in range(50)]).repartition(3)
    write_dump(pages, f"{scheme}{tmp_path}/out", "bzip2")
    files = list((tmp_path / "out").iterdir())
    assert len(files) == 3
    # Spark's own writer makes blocks of 900 kB, BZh9.
    assert {file.read_bytes()[:4] for file in files} == {b"BZh1"}
    assert {file.name[-8:] for file in files} == {".txt.bz2"}
    assert rows_of(good_pages(read_dump(spark, f"{scheme}{tmp_path}/out"))) == rows_of(pages)


def test_lines_are_those_of_sparks_writer(spark, tmp_path):
    lines = spark.range(7, numPartitions=2).select(
        F.expr("CASE id WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN CAST(X'FF00C3' AS STRING) ELSE concat('é', id) END AS value")
    )
    write_lines(lines, F.col("value"), str(tmp_path / "ours"))
    lines.write.text(str(tmp_path / "spark"), compression="bzip2")
    ours, theirs = ([bz2.decompress(f.read_bytes()) for f in (tmp_path / name).glob("*.bz2")] for name in ("ours", "spark"))
    assert sorted(ours) == sorted(theirs)


def test_empty_partitions_make_no_files(spark, tmp_path, make_pages):
    pages = make_pages((1, "a", "x")).repartition(4)
    write_dump(pages, str(tmp_path / "one"), "bzip2")
    assert len(list((tmp_path / "one").iterdir())) == 1
    write_dump(pages.filter("page_id > 1"), str(tmp_path / "none"), "bzip2")
    assert rows_of(read_dump(spark, str(tmp_path / "none"))) == []


def test_a_dump_is_not_written_over(spark, tmp_path, make_pages):
    pages = make_pages((1, "a", "x"))
    for compression in (None, "bzip2"):
        path = str(tmp_path / f"out-{compression}")
        write_dump(pages, path, compression)
        with pytest.raises((AnalysisException, FileExistsError)):
            write_dump(pages, path, compression)
        assert rows_of(good_pages(read_dump(spark, path))) == rows_of(pages)


def test_only_files_of_the_attempts_that_count_are_read(spark, tmp_path):
    hidden = tmp_path / UNFINISHED
    hidden.mkdir()
    for name in ("part-1.txt.bz2", "part-2.txt.bz2"):
        (hidden / name).write_bytes(bz2.compress(page(1, "a", revision("x")).encode()))
    Bz2Writer(str(tmp_path)).commit([Written("part-1.txt.bz2"), Written(None), None])
    assert rows_of(good_pages(read_dump(spark, str(tmp_path)))) == [(1, "a", "x")]


def test_folders_of_other_file_systems_are_left_to_spark(spark):
    assert mounted_folder(spark, "/a/b") == mounted_folder(spark, "file:/a/b") == mounted_folder(spark, "file:///a/b") == "/a/b"
    assert mounted_folder(spark, "file:///a%20b c") == "/a%20b c"
    for path in ("hdfs:///a", "hdfs://host/a", "s3a://a/b", "file://host/a", "a/b", "//host/a"):
        assert mounted_folder(spark, path) is None


def test_bz2_dumps_are_unpacked_once(spark, tmp_path):
    """The search for cut pages leaves what it has unpacked; files with cut pages are put together as ever."""
    broken = page(2, "b", "<revision><text>y</txt></revision>\n")
    (tmp_path / "a.xml.bz2").write_bytes(bz2.compress(dump_of(page(1, "a", revision(" x ")), broken).encode()))
    pages = read_dump(spark, str(tmp_path))
    assert {name.rsplit(".", 1)[1] for name in pages.inputFiles()} == {"parquet"}
    assert rows_of(good_pages(pages)) == [(1, "a", " x ")]
    assert ["<title>b</title>" in row[0] for row in rows_of(corrupt_pages(pages))] == [True]
    cut = [page(n, f"c{n}", cdata(f"x </page> {n}")) for n in (3, 3, 4)]
    (tmp_path / "c.xml.bz2").write_bytes(bz2.compress(dump_of(*cut).encode()))
    (tmp_path / "d.xml").write_text(dump_of(page(5, "d", revision("plain"))))
    pages = read_dump(spark, str(tmp_path))
    expected = [(1, "a", " x "), (3, "c3", "x </page> 3"), (3, "c3", "x </page> 3"), (4, "c4", "x </page> 4"), (5, "d", "plain")]
    assert rows_of(good_pages(pages)) == expected
    assert len(rows_of(corrupt_pages(pages))) == 1
    # A search for a string makes no copy of the dump.
    found = read_dump(spark, str(tmp_path / "a.xml.bz2"), containing="x")
    assert {name.rsplit(".", 1)[1] for name in found.inputFiles()} == {"bz2"}
    assert rows_of(good_pages(found)) == [(1, "a", " x ")]
