"""SimHash near-duplicates: pigeonring chains prune the candidates before the Hamming check.

A fingerprint has 64 bits in five consecutive segments on a ring. Two fingerprints that differ
in at most ``MAX_BITS`` = 4 bits have a segment from which every chain of 1, 2, ... 5 segments
differs in at most 0, 1, ... 4 bits (the pigeonring principle with whole-number budgets: with
five segments and four differing bits the budget of a chain of n segments is n - 1).

The first two conditions of a chain become join keys: the start segment is equal, and the next
one is equal but for one masked bit. The longer chains are checked for the fingerprints that
meet under a key, before the full distance. So a fingerprint has one key per start and masked bit, 64 in all, and each
key fixes 24 or 25 bits.

Only different fingerprints are joined; copies are rows of one fingerprint. A key that more
than ``PAIR_LIMIT`` fingerprints share would give too many pairs. Its fingerprints are linked
without pairs: two of them are within four bits exactly if one point of the cube is within two
bits of both. Each emits the 2081 points around it, and those that meet in a point are linked.
A point meets at most 2081 fingerprints, so no group grows with the data, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from verbarium.llm.common import components, map_rows, staged, text_bytes

SHINGLE = 4
SEED = 42
MAX_BITS = 4
# Lowest bit and width of the five segments.
SEGMENTS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
# Fingerprints under one key up to which their pairs are compared one by one.
PAIR_LIMIT = 64


def fingerprint_of(text: bytes) -> int:
    """The 64-bit fingerprint of one text as a signed number.

    Words are joined by one blank, so a shingle is a slice of the joined text.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return _signed(xxhash.xxh64_intdigest(b" ".join(words), SEED))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: -SHINGLE].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[i:j], SEED) for i, j in zip(starts, stops, strict=True)], np.uint64
    )
    return _signed(majority(hashes))


def majority(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have; blocks bound the memory of long texts."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fp`` (long) of every document; a null or blank text has 0."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        return {"doc_id": rows["doc_id"], "fp": [fingerprint_of(t) for t in rows["_text"]]}

    chosen = docs.select("doc_id", text_bytes().alias("_text"))
    return map_rows(chosen, work, StructType([docs.schema["doc_id"], StructField("fp", LongType())]))


def _segment(fp: Column, k: int) -> Column:
    low, width = SEGMENTS[k % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, low).bitwiseAND((1 << width) - 1)


def chain_keys(fp: Column) -> Column:
    """One key per chain start and masked bit of the next segment; different parts never meet."""
    keys = []
    number = 0
    for k in range(len(SEGMENTS)):
        start, after = _segment(fp, k), _segment(fp, k + 1)
        for bit in range(SEGMENTS[(k + 1) % len(SEGMENTS)][1]):
            masked = after.bitwiseAND(~(1 << bit))
            keys.append(
                F.shiftleft(F.lit(number).cast("long"), 32)
                .bitwiseOR(F.shiftleft(start, 13))
                .bitwiseOR(masked)
            )
            number += 1
    return F.array(*keys)


def chain_holds(difference: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Whether the chains of pairs stay within their budgets; ``number``: the parts of their keys."""
    bits = [np.bitwise_count(difference >> np.uint64(low) & np.uint64((1 << width) - 1)) for low, width in SEGMENTS]
    starts = np.repeat(np.arange(len(SEGMENTS)), [SEGMENTS[(k + 1) % len(SEGMENTS)][1] for k in range(len(SEGMENTS))])
    held = np.ones(len(difference), bool)
    total = np.zeros(len(difference), np.int64)
    by_segment = np.array(bits)
    rows = np.arange(len(difference))
    for n in range(len(SEGMENTS)):
        total += by_segment[(starts[number] + n) % len(SEGMENTS), rows]
        held &= total <= n
    return held


def compare_bucket_rows(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Linked pairs (a, b) under the keys of rows (key, fp) that come sorted by key.

    The fingerprints of keys with more than ``limit`` rows come out as (a, null). No more than
    ``limit`` rows of a key are ever held.
    """
    keys, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
    hot: int | None = None

    def settle(last: bool) -> pa.RecordBatch:
        """Compare the complete keys among the rows held; keep those of the last key."""
        nonlocal keys, prints, hot
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        single = np.zeros(0, np.int64)
        if len(keys):
            first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
            sizes = np.diff(first, append=len(keys))
            size = np.repeat(sizes, sizes)
            large = size > limit
            if hot is not None:
                large |= keys == hot
            hot = int(keys[-1]) if large[-1] else None
            # Rows of the last key wait for the next batch, unless it is hot already.
            open_rows = 0 if last or large[-1] else int(sizes[-1])
            single = np.unique(prints[large])
            ready = np.arange(len(keys) - open_rows)
            ready = ready[~large[: len(ready)]]
            step = 1
            while len(ready):
                ready = ready[ready + step < len(keys) - open_rows]
                ready = ready[keys[ready] == keys[ready + step]]
                a, b = prints[ready], prints[ready + step]
                difference = a.view(np.uint64) ^ b.view(np.uint64)
                linked = chain_holds(difference, keys[ready] >> 32)
                linked &= np.bitwise_count(difference) <= MAX_BITS
                linked &= difference != 0
                out_a.append(np.minimum(a, b)[linked])
                out_b.append(np.maximum(a, b)[linked])
                step += 1
            keys, prints = (x[len(keys) - open_rows :] for x in (keys, prints))
        pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)]), axis=1)
        first_column = pa.array(np.concatenate([pairs[0], single]))
        second_column = pa.concat_arrays([pa.array(pairs[1]), pa.nulls(len(single), pa.int64())])
        return pa.RecordBatch.from_arrays([first_column, second_column], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
        prints = np.concatenate([prints, batch.column(1).to_numpy(zero_copy_only=False)])
        yield settle(last=False)
    yield settle(last=True)


def ball_masks() -> np.ndarray:
    """All differences of at most two bits."""
    bits = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i, j in combinations(range(64), 2)]
    return np.array(bits, np.uint64)


def ball_points(hot: DataFrame) -> DataFrame:
    """(point, fp): every point within two bits of every fingerprint of ``hot``."""
    masks = ball_masks()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(fps), 256):
                part = fps[at : at + 256]
                points = (part[:, None] ^ masks[None, :]).view(np.int64).ravel()
                centres = np.repeat(part.view(np.int64), len(masks))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(points), pa.array(centres)], names=["point", "fp"]
                )

    return hot.mapInArrow(over, "point long, fp long")


def fingerprint_links(distinct: DataFrame, limit: int = PAIR_LIMIT) -> DataFrame:
    """Links (a, b) that connect exactly what pairs within ``MAX_BITS`` bits connect.

    ``distinct``: one row ``fp`` per different fingerprint. The keys are shuffled once.
    """
    keyed = distinct.select(F.explode(chain_keys(F.col("fp"))).alias("key"), "fp")
    sorted_rows = keyed.repartition("key").sortWithinPartitions("key")
    compared = staged(
        sorted_rows.mapInArrow(lambda rows: compare_bucket_rows(rows, limit), "a long, b long").distinct(), "compared"
    )
    points = ball_points(compared.where("b IS NULL").select(F.col("a").alias("fp")))
    met = points.groupBy("point").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))
    met = met.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b")
    return compared.where("b IS NOT NULL").union(met.distinct())


def near_duplicates(docs: DataFrame, limit: int = PAIR_LIMIT) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable by links, the row's own included. Rows
    with a null doc_id link like any other and never give the name of a component: theirs is
    the smallest doc_id of the others, or null if there is none. Texts without words have
    fingerprint 0. Repeated rows stay repeated; an empty table gives an empty result.
    """
    rows = staged(fingerprints(docs), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    links = staged(fingerprint_links(distinct.select("fp"), limit), "links")
    found = components(links, "simhash-rounds").withColumnRenamed("node", "fp")
    grouped = distinct.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(names, "component").select("fp", "component", "component_id")
    return rows.join(named, "fp").select(
        "doc_id",
        "fp",
        "component",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns.

    The one with the smallest doc_id stays, rows without a doc_id last, then by fingerprint and
    hash of the whole row; so rows that share a doc_id and hold unrelated texts all stay. Rows
    equal in all columns are one document. A row is known by two hashes of all its columns, and
    columns of any name do. An empty table gives an empty result.
    """
    cells = [cell for c in docs.columns for cell in (_quoted(c).isNull(), _quoted(c))]
    hashes = F.struct(F.xxhash64(*cells).alias("r1"), F.xxhash64(F.lit(7), *cells).alias("r2"))
    known = near_duplicates(docs.select(F.struct(_quoted("doc_id").alias("id"), hashes.alias("r")).alias("doc_id"), "text"))
    place = F.struct(F.col("doc_id.id").isNull().alias("nameless"), "doc_id.id", "fp", F.col("doc_id.r.r1").alias("r1"), F.col("doc_id.r.r2").alias("r2"))
    chosen = staged(
        known.groupBy("component", place.alias("place"))
        .agg(F.count("*").alias("n"))
        .groupBy("component")
        .agg(F.min_by(F.struct("place.r1", "place.r2", "n"), "place").alias("one"))
        .select("one.*"),
        "chosen",
    )
    rows = docs.select(hashes.alias("r"), F.struct(*map(_quoted, docs.columns)).alias("row")).select("r.*", "row")
    kept = rows.join(chosen.where("n = 1"), ["r1", "r2"], "left_semi").select("row")
    repeated = chosen.where("n > 1")
    if not repeated.isEmpty():
        copies = rows.join(repeated, ["r1", "r2"], "left_semi")
        kept = kept.union(copies.groupBy("r1", "r2").agg(F.first("row").alias("row")).select("row"))
    return kept.select("row.*")


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")
