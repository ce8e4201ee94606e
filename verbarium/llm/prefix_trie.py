"""Prefix trie of conversations, rolled up by depth bands.

A node is a distinct sequence of first turns. It is known by 128 bits, the exclusive or of a hash
of each turn with its depth, so the keys of all prefixes of a conversation are running values
over its sorted turns. Those are kept per partition and put together from one row per partition,
so that a conversation of any length spreads over many tasks.

Totals of subtrees come by bands of ``BAND`` levels. The path of a conversation is cut into one
row per band with its at most ``BAND + 1`` keys; a node's values stand with the smallest
conversation through it. Each node gives its value to its ancestors in its band only, added up
within the path before the shuffle. The roots of the bands form a trie of ``1 / BAND`` of the
depth, whose totals come the same way, and are then given to the ancestors in the band above. So
the number of rounds grows with the logarithm of the depth, and a row explodes into at most
``BAND`` rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from verbarium.llm.common import staged, word_count

BAND = 16
# A conversation starts with turns of the first one of its block of ids.
BLOCK = 20
HEADS = 4
CHUNK_IDS = 4096
KEY = ["k1", "k2"]


def running(df: DataFrame, order: list[str], xors: list[str], name: str) -> DataFrame:
    """Add ``place`` (from 1) of each row in its ``conv_id`` by ``order``, and turn the long columns
    ``xors`` into their running exclusive or; the columns of ``order`` go.

    Rows are range-partitioned by conversation and order, so one conversation may fill many
    partitions. Only one row per partition meets on the driver.
    """
    kept = [c for c in df.columns if c not in order]
    laid_out = df.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).select(kept)
    added = [StructField(c, LongType()) for c in ("_part", "_row", "_start")]
    schema = StructType([*laid_out.schema.fields, *added])
    arrow_schema = to_arrow_schema(schema)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows, conv, start, carried = 0, None, 0, dict.fromkeys(xors, np.int64(0))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = {c: batch.column(c) for c in kept}
            convs = columns["conv_id"].to_numpy(zero_copy_only=False)
            new = np.empty(n, bool)
            new[0] = conv is None or convs[0] != conv
            new[1:] = convs[1:] != convs[:-1]
            # Row of the batch at which the conversation starts, -1 for the one already open.
            first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            starts = np.where(first < 0, start, rows + first)
            for c in xors:
                values = np.bitwise_xor.accumulate(columns[c].to_numpy(zero_copy_only=False))
                before = np.concatenate([values[-1:] * 0, values])
                values = values ^ np.where(first < 0, carried[c], before[np.maximum(first, 0)])
                columns[c], carried[c] = pa.array(values), values[-1]
            columns |= {"_part": pa.array(np.full(n, part)), "_row": pa.array(np.arange(rows, rows + n)), "_start": pa.array(starts)}
            rows, conv, start = rows + n, convs[-1], starts[-1]
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in arrow_schema], schema=arrow_schema)

    placed = staged(laid_out.mapInArrow(over, schema), name)
    parts = placed.groupBy("_part").agg(
        F.count("*").alias("n"),
        F.min("conv_id").alias("first"),
        F.max("conv_id").alias("last"),
        F.max("_start").alias("start"),
        *[F.max_by(c, "_row").alias(c) for c in xors],
    )
    offsets, before, last, start, totals = [], 0, None, 0, dict.fromkeys(xors, 0)
    for part in parts.orderBy("_part").collect():
        goes_on = part["first"] == last
        offsets.append((part["_part"], before, last if goes_on else None, start if goes_on else 0, *totals.values()))
        if part["first"] == part["last"] and goes_on:
            totals = {c: totals[c] ^ part[c] for c in xors}
        else:
            start, totals = before + part["start"], {c: part[c] for c in xors}
        before, last = before + part["n"], part["last"]
    names = ["_part", "_before", "_open", "_open_start", *[f"_{c}" for c in xors]]
    known = df.sparkSession.createDataFrame(offsets, ", ".join(f"{c} long" for c in names))
    goes_on = F.col("conv_id").eqNullSafe(F.col("_open"))
    started = F.when(goes_on, F.col("_open_start")).otherwise(F.col("_before") + F.col("_start"))
    return placed.join(F.broadcast(known), "_part").select(
        *[F.when(goes_on, F.col(c).bitwiseXOR(F.col(f"_{c}"))).otherwise(F.col(c)).alias(c) if c in xors else c for c in kept],
        (F.col("_before") + F.col("_row") - started + 1).alias("place"),
    )


def heads(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the first one of its block."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, depth, words, h1, h2) of all rebuilt turns, and one of depth 0 for every
    conversation; and rows (conv_id, depth) of the last ones."""
    texts = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    hashed = texts.select(
        "*",
        F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit(1), "text", "role").alias("h2"),
        word_count(F.col("text")).alias("words"),
    )
    turns = running(hashed, ["turn", "role", "text"], [], "trie-turns")
    block = F.col("conv_id") - F.col("conv_id") % BLOCK
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    firsts = sizes.select(F.col("conv_id").alias("block"), F.col("n").alias("block_n"))
    convs = sizes.select("*", heads(F.col("conv_id")).alias("h"), block.alias("block")).join(firsts, "block", "left")
    convs = staged(convs.select("*", F.least("h", F.coalesce("block_n", F.lit(0))).alias("taken")), "trie-convs")

    first_turns = turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("place") < HEADS))
    first_turns = first_turns.select(F.col("conv_id").alias("block"), F.col("place").alias("depth"), "words", "h1", "h2")
    taken = convs.where("taken > 0").select("conv_id", "block", "taken").join(first_turns, "block")
    taken = taken.where("depth <= taken").drop("block", "taken")
    # Few conversations need a shift: those whose block has fewer turns to take over than they ask for.
    shifts = convs.where("taken < h").select("conv_id", (F.col("taken") - F.col("h")).alias("shift"))
    own = turns.where(F.col("place") > heads(F.col("conv_id"))).join(shifts, "conv_id", "left")
    own = own.select("conv_id", (F.col("place") + F.coalesce("shift", F.lit(0))).alias("depth"), "words", "h1", "h2")
    zero = F.lit(0).cast("long")
    tops = convs.select("conv_id", *[zero.alias(c) for c in ("depth", "words", "h1", "h2")])
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return own.unionByName(taken).unionByName(tops), convs.select("conv_id", length.alias("depth"))


def paths_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, depth, words, k1, k2, p1, p2) of all prefixes of all rebuilt conversations, p the key
    of the prefix without its last turn; and rows (conv_id, k1, k2) of the whole ones."""
    rows, lengths = rebuilt(conversations)
    inner = F.col("depth") > 0
    salted = rows.select(
        "conv_id",
        "depth",
        F.col("depth").alias("_order"),
        "words",
        F.when(inner, F.xxhash64("depth", "h1", "h2")).otherwise(0).alias("k1"),
        F.when(inner, F.xxhash64("h2", "depth", "h1")).otherwise(0).alias("k2"),
    )
    own = salted.select("*", F.col("k1").alias("g1"), F.col("k2").alias("g2"))
    keyed = running(own, ["_order"], KEY, "trie-paths")
    paths = staged(
        keyed.select("conv_id", "depth", "words", *KEY, *[F.col(k).bitwiseXOR(F.col(g)).alias(p) for k, g, p in (("k1", "g1", "p1"), ("k2", "g2", "p2"))]),
        "trie-keys",
    )
    return paths, paths.join(lengths, ["conv_id", "depth"], "left_semi").select("conv_id", *KEY)


def band_of(depth: str) -> Column:
    """A root of a band also stands at the foot of the band above, which is the one meant here."""
    return F.floor((F.col(depth) - 1) / BAND)


def given(paths: DataFrame, values: DataFrame, receives: Column) -> DataFrame:
    """Sums (k1, k2, leaves, saved) of what the ancestors that ``receive`` get from ``values`` in their band."""
    members = paths.select("conv_id", F.explode(F.array_distinct(F.array(band_of("depth"), F.floor(F.col("depth") / BAND)))).alias("band"), "depth", *KEY)
    bands = members.where("band >= 0").groupBy("conv_id", "band").agg(F.collect_list(F.struct("depth", *KEY)).alias("steps"))
    own = values.where("depth > 0").groupBy("conv_id", band_of("depth").alias("band")).agg(
        F.collect_list(F.struct("depth", "leaves", "saved")).alias("gifts"), F.max("depth").alias("deepest")
    )
    joined = bands.join(own, ["conv_id", "band"]).select("gifts", "deepest", F.explode("steps").alias("step")).select("gifts", "deepest", "step.*")

    def below(name: str) -> Column:
        return F.aggregate("gifts", F.lit(0).cast("long"), lambda total, g: total + F.when(g["depth"] > F.col("depth"), g[name]).otherwise(0))

    sums = joined.where(receives & (F.col("depth") < F.col("deepest"))).select(*KEY, below("leaves").alias("leaves"), below("saved").alias("saved"))
    return sums.groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def added(nodes: DataFrame, sums: DataFrame) -> DataFrame:
    gifts = sums.select(*KEY, F.col("leaves").alias("_leaves"), F.col("saved").alias("_saved"))
    total = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
    return nodes.join(gifts, KEY, "left").select("conv_id", "depth", *KEY, *total)


def rolled_up(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` (conv_id, depth, k1, k2, leaves, saved), their values summed over their subtrees."""
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None or deepest <= BAND:
        return staged(added(nodes, given(paths, nodes, F.lit(True))), "trie-totals")
    is_root = F.col("depth") % BAND == 0
    up = (F.col("depth") / BAND).cast("long")
    within = nodes.where(~is_root)
    roots = staged(added(nodes.where(is_root), given(paths, within, is_root)).withColumn("depth", up), "trie-roots")
    complete = rolled_up(paths.where(is_root).withColumn("depth", up), roots).withColumn("depth", F.col("depth") * BAND)
    sums = given(paths, within.unionByName(complete), ~is_root)
    return staged(added(within, sums).unionByName(complete), "trie-totals")


def end_digests(ends: DataFrame) -> DataFrame:
    """k1, k2 and the digest of the rising ids of the conversations that end at the node.

    The ids of a node are sorted and written out in chunks by as many tasks as they need; the
    digest, which can only go from front to back, then streams over the chunks.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in KEY])
            ids = batch.column("conv_id").to_pylist()
            cuts = set((np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist())
            cuts = sorted(cuts | set(range(0, len(ids), CHUNK_IDS)) | {len(ids)})
            spans = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
            columns = [*[pa.array([int(k[a]) for a, _ in spans], pa.int64()) for k in keys], pa.array([ids[a] for a, _ in spans], pa.int64())]
            text = pa.array([",".join(map(str, ids[a:b])) for a, b in spans], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, text], names=[*KEY, "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k1, k2, ids in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ids")], strict=True):
                if key == (k1, k2):
                    state.update(f",{ids}".encode())
                    continue
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(ids.encode())
            yield finished(done)
        if key:
            yield finished([(*key, state.hexdigest())])

    def finished(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*KEY, "ends_sha256"])

    order = [*KEY, "conv_id"]
    cut = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, "k1 long, k2 long, first long, ids string")
    return cut.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, "k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    conv_id: smallest member; depth; parent_conv_id: the parent's conv_id, null for the root;
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256 as named.

    Rows without conv_id belong to no conversation and are left out. A null role or text counts
    as empty, a null turn comes first, equal turns go by role and text (code points), and a
    repeated row is a turn of its own. Texts of any length are hashed whole. An empty table has
    no nodes, not even a root. Other columns, whatever their names, are not read.
    """
    paths, ends = paths_of(conversations)
    nodes = staged(
        paths.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"),
            F.max("depth").alias("depth"),
            F.count("*").alias("n_convs"),
            F.max("words").alias("words"),
            F.max("p1").alias("p1"),
            F.max("p2").alias("p2"),
        ),
        "trie-nodes",
    )
    inner = nodes.where("depth > 0")
    children = inner.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = staged(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "trie-children")
    own = nodes.select("conv_id", "depth", *KEY, (F.col("n_children") == 0).cast("long").alias("leaves"), "saved")
    totals = rolled_up(paths.select("conv_id", "depth", *KEY), own).select(*KEY, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))

    # A parent with very many children is a hot key of this join, which the adaptive planner splits.
    parents = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    edges = nodes.where("depth > 0").select(*KEY, "p1", "p2").join(parents, ["p1", "p2"]).select(*KEY, "parent_conv_id")
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(totals, KEY)
        .join(end_digests(ends), KEY, "left")
        .join(edges, KEY, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )
