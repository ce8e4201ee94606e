"""Wiki XML dumps, plain or bz2, as DataFrames of pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbarium.session import scratch_path, stage
from verbarium.sources.bz2_files import mounted_folder, write_lines

PAGE_END = "</page>"
PAGE_START = r"<page[\s>]"
PAGE = rf"(?s){PAGE_START}.*"
NO_PAGE = r"^\s*(</[A-Za-z]+>)?\s*$"
CDATA = "<![CDATA["
CDATA_END = "]]>"
# For the test without decoding: page, revision, contributor, name.
NESTING = 4
_ATTRIBUTES = r'(?: [A-Za-z:]+="[^"<>&]*")*'
EMPTY_ELEMENT = rf"<([A-Za-z][A-Za-z0-9]*){_ATTRIBUTES}></\1>|<[A-Za-z][A-Za-z0-9]*{_ATTRIBUTES} ?/>"
TWICE = rf' ([A-Za-z:]+)="[^"]*"{_ATTRIBUTES} \1="'
# Entities that XML does not know, characters that it does not allow, what else the fields may not hold.
DOUBTFUL = (
    r"&(?!(?:amp|lt|gt|quot|apos);)|[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]|\]\]>"
    r"|<id>(?![0-9]{1,18}</id>)|<revision>\s*[^<\s]"
)
CORRUPT = "_corrupt_record"
FIELDS = f"title string, id bigint, revision struct<text: string>, {CORRUPT} string"
# Surrounding blanks belong to the wikitext.
XML_OPTIONS = {
    "mode": "PERMISSIVE",
    "ignoreSurroundingSpaces": "false",
    "columnNameOfCorruptRecord": CORRUPT,
}


def dump_chunks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The pieces of dump files between page ends: value, file and block.

    Plain and bz2 files are read by many tasks; ``block`` is where a task's part of a file begins.
    """
    return _placed(spark.read.option("lineSep", PAGE_END).text(path))


def dump_chunk_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same as a stream over the files that arrive in a folder; ``decode_chunks`` takes its
    micro-batches, which hold whole files."""
    reader = spark.readStream.option("lineSep", PAGE_END)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _placed(reader.text(path))


def _placed(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def read_dump(
    spark: SparkSession, path: str | list[str], containing: str | None = None
) -> DataFrame:
    """Pages of a dump; see ``decode_chunks``."""
    chunks = dump_chunks(spark, path)
    # A search for a string needs few chunks, which are not worth a copy of the dump.
    packed = containing is None and any(name.endswith(".bz2") for name in chunks.inputFiles())
    return pages_of(whole_chunks(chunks, packed), containing)


def decode_chunks(chunks: DataFrame, containing: str | None = None) -> DataFrame:
    """Pages of dump chunks: page_id, title, text and, for broken ones, _corrupt_record.

    ``containing`` keeps only pages whose text may contain this string (plain characters
    without XML escapes), and the broken ones. The test comes before the XML is decoded, which
    then happens for the pages that pass and for those that are not plainly well-formed.
    """
    return pages_of(whole_chunks(chunks), containing)


def whole_chunks(chunks: DataFrame, packed: bool = False) -> DataFrame:
    """Column ``value``: chunks that each end where a page ends.

    A page end inside a CDATA section ends no page. Whether a chunk starts inside of one is
    known from the last mark before it, so a search of all chunks in parallel, for those that
    leave a section open, tells which files have cut pages; mostly none. Their chunks get a copy in
    the scratch area, where they keep their places whatever executors are lost. Only the chunks of
    pages that are cut move; they are put together as ``cut_pages`` says.

    Files whose unpacking is the costly part (``packed``) are unpacked once, into the scratch area,
    with the answer of the search; only those with cut pages are unpacked again, as their chunks
    have to be in place.
    """
    # In this order most chunks are searched for one string only.
    leaves_open = F.col("value").contains(CDATA) & _mark(F.col("value"))
    read = chunks.select("value", "file", leaves_open.alias("leaves_open"))
    if packed:
        read = stage(read, scratch_path(chunks.sparkSession, "unpacked"))
    rows = read.filter("leaves_open").select("file").distinct().collect()
    if not rows:
        return read.select("value")
    in_cut_file = F.col("file").isin([row["file"] for row in rows])
    marked = chunks.filter(in_cut_file).select("*", F.monotonically_increasing_id().alias("place"), _mark(F.col("value")).alias("mark"))
    kept = stage(
        marked.select("*", mark_before()(F.col("mark"), F.xxhash64("file", "block")).alias("seen")),
        scratch_path(chunks.sparkSession, "cut-files"),
    )
    placed = with_state(kept)
    inner = placed.filter("inside OR open")
    place = ["file", "block", "place"]
    parts = stage(cut_pages(inner.select(*place, "mark")), scratch_path(chunks.sparkSession, "cut-pages"))
    inner = inner.select(*place, "value")
    pieces = F.sort_array(F.collect_list(F.struct("block", "place", "value")))
    joined = inner.join(parts, place).groupBy("file", "start").agg(
        F.array_join(F.transform(pieces, lambda piece: piece["value"]), PAGE_END).alias("value")
    )
    # Those of sections that never end stay as they are.
    others = [placed.filter("NOT (inside OR open)"), inner.join(parts, place, "left_anti"), joined]
    whole = read.filter(~in_cut_file).select("value")
    for rows in others:
        whole = whole.unionByName(rows.select("value"))
    return whole


def mark_before():
    """A column function of (mark, key of the block): the last mark before the chunk in its block.

    It is null until a block's first mark. A task reads its blocks in order, so the mark is carried
    along and no chunk moves; only marks and keys reach Python.
    """

    def carry(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last_key, last_mark = None, None
        for marks, keys in batches:
            n = len(marks)
            if not n:
                yield pa.nulls(0, pa.bool_())
                continue
            key = keys.to_numpy(zero_copy_only=False)
            at = np.arange(n)
            first = np.maximum.accumulate(np.where(np.diff(key, prepend=key[:1]) != 0, at, 0))
            valid = np.maximum.accumulate(np.where(marks.is_valid().to_numpy(zero_copy_only=False), at, -1))
            before = np.concatenate([[-1], valid[:-1]])
            seen = marks.take(pa.array(before, mask=before < first))
            if last_mark is not None and key[0] == last_key:
                # Up to the first mark of this batch, the block's last one of the batches before holds.
                carried = pa.array((first == 0) & (before < 0))
                seen = pc.if_else(carried, pa.scalar(last_mark, pa.bool_()), seen)
            end = valid[-1]
            if end >= first[-1]:
                last_mark = marks[int(end)].as_py()
            elif key[-1] != last_key:
                last_mark = None
            last_key = key[-1]
            yield seen

    return F.arrow_udf(carry, "boolean").asNondeterministic()


def with_state(kept: DataFrame) -> DataFrame:
    """Add to chunks with ``mark`` and ``seen`` whether they start ``inside`` a section and leave it ``open``.

    What holds at the start of a block, one row per block, meets the chunks by broadcast.
    """
    last = F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("place")))
    blocks = kept.groupBy("file", "block").agg(last.alias("end"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = blocks.select("file", "block", F.last("end", ignorenulls=True).over(earlier).alias("before"))
    inside = F.coalesce("seen", "before", F.lit(False))
    placed = kept.join(F.broadcast(states), ["file", "block"])
    return placed.withColumn("inside", inside).withColumn("open", F.coalesce("mark", "inside"))


def _mark(value: Column) -> Column:
    """Whether the chunk's last CDATA mark opens a section (true) or closes one; null without marks.

    The last mark alone decides, whether or not the chunk starts inside of a section.
    """
    opens = value.contains(CDATA) & ~F.substring_index(value, CDATA, -1).contains(CDATA_END)
    return F.when(opens, True).when(value.contains(CDATA_END), False)


def cut_pages(keys: DataFrame) -> DataFrame:
    """The chunks (file, block, place) of pages that are cut inside a CDATA section, with the
    ``start`` that they share.

    ``keys`` holds all chunks with their ``mark``, or all that lie in a section or leave one open. A page whose section never ends is no such page.
    """
    marked = _carried(keys, F.col("mark"), "inside", -1).withColumn("inside", F.coalesce("inside", F.lit(False)))
    marked = marked.withColumn("open", F.coalesce("mark", "inside"))
    starts = F.when(~F.col("inside") & F.col("open"), F.struct("block", "place"))
    members = _carried(marked, starts, "start", 0).filter("inside OR open")
    ended = members.filter("NOT open").select("file", "start").distinct()
    return members.join(ended, ["file", "start"], "left_semi").select("file", "block", "place", "start")


def _carried(keys: DataFrame, value: Column, name: str, upto: int) -> DataFrame:
    """Add ``name``: the last ``value`` that is not null among the chunks of the file, up to the own
    one (0) or the one before it (-1).

    The windows run over the chunks of a block, which are a task's part of a file, and over one
    row per block of a file.
    """
    first = Window.unboundedPreceding
    block = ["file", "block"]
    valued = keys.withColumn("_value", value)
    ends = valued.filter(F.col("_value").isNotNull()).groupBy(*block).agg(F.max_by("_value", "place").alias("_end"))
    blocks = keys.select(*block).distinct().join(ends, block, "left")
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(first, -1))
    within = F.last("_value", ignorenulls=True).over(Window.partitionBy(*block).orderBy("place").rowsBetween(first, upto))
    joined = valued.join(blocks.select(*block, before.alias("_before")), block)
    return joined.select(*keys.columns, F.coalesce(within, "_before").alias(name))


def pages_of(chunks: DataFrame, containing: str | None = None) -> DataFrame:
    """Decode text chunks that each end where a page ends."""
    value = F.col("value")
    # What follows the last page is no page; the start of a tag spares most chunks the regex.
    kept = value.contains("<page") | ~value.rlike(NO_PAGE)
    if containing is not None:
        # A numeric character reference could spell the string in another way.
        kept = kept & (value.contains(containing) | value.contains("&#") | ~_well_formed(value))
    # Mostly only blanks stand before the page.
    trimmed = F.ltrim(value, F.lit(" \n"))
    # A chunk without the start of a page is the rest of one that was cut; it fails to decode.
    found = F.when(value.rlike(PAGE_START), F.regexp_extract("value", PAGE, 0)).otherwise(value)
    fragment = F.when(trimmed.startswith("<page>"), trimmed).otherwise(found)
    fragments = chunks.filter(kept).select(F.explode(F.array(fragment)).alias("fragment"))
    decoded = F.from_xml(F.concat("fragment", F.lit(PAGE_END)), FIELDS, XML_OPTIONS)
    # As a generator the decoding runs once per page. In a plain projection every filter that
    # the optimizer moves below it would decode the page again.
    pages = _fields(fragments.select(F.inline(F.array(decoded))))
    if containing is not None:
        pages = pages.filter(F.col("text").contains(containing) | F.col(CORRUPT).isNotNull())
    return pages


def _well_formed(value: Column) -> Column:
    """True only for chunks that surely decode, told without decoding them: what is left without the
    texts vanishes when elements without content are taken out, from the inside."""
    tags = F.concat(F.regexp_replace(F.regexp_extract(value, PAGE, 0), ">[^<]+", ">"), F.lit(PAGE_END))
    left = tags
    for _ in range(NESTING):
        left = F.regexp_replace(left, EMPTY_ELEMENT, "")
    return (left == "") & ~value.rlike(DOUBTFUL) & ~tags.rlike(TWICE)


def _fields(page: DataFrame) -> DataFrame:
    return page.select(
        F.col("id").alias("page_id"),
        # Absent elements count as empty.
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("revision.text", F.lit("")).alias("text"),
        CORRUPT,
    )


def good_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def corrupt_pages(pages: DataFrame) -> DataFrame:
    """The raw text of the pages that could not be decoded."""
    return pages.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def page_xml(pages: DataFrame, as_cdata: Column | None = None) -> DataFrame:
    """Each page as XML in column ``value``, beside its own columns.

    Texts are escaped, or stand in CDATA sections where ``as_cdata`` holds.
    """
    text = _escaped(F.col("text"))
    if as_cdata is not None:
        # A section cannot hold its own end, so it is split there.
        split = F.replace("text", F.lit(CDATA_END), F.lit("]]" + CDATA_END + CDATA + ">"))
        text = F.when(as_cdata, F.concat(F.lit(CDATA), split, F.lit(CDATA_END))).otherwise(text)
    xml = F.concat(
        F.lit("  <page>\n    <title>"),
        _escaped(F.col("title")),
        F.lit("</title>\n    <ns>0</ns>\n    <id>"),
        F.col("page_id").cast("string"),
        F.lit("</id>\n    <revision>\n      <id>1</id>\n      <text xml:space=\"preserve\">"),
        text,
        F.lit("</text>\n    </revision>\n  </page>"),
    )
    return pages.withColumn("value", xml)


def write_dump(pages: DataFrame, path: str, compression: str | None = None) -> None:
    """Write pages as XML dump files, one per task; ``compression`` may be 'bzip2'."""
    xml = page_xml(pages)
    folder = mounted_folder(pages.sparkSession, path) if compression == "bzip2" else None
    if folder:
        write_lines(xml, F.col("value"), folder)
    else:
        xml.select("value").write.text(path, compression=compression)


def _escaped(text: Column) -> Column:
    for raw, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text
