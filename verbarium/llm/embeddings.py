"""Embedding near-dedup: a forest of random-projection trees with measured spill overlap.

Vectors are compared only under equal labels, so every label is a root in every tree. A node is
split at a cut of its projection on one of several random directions; what lies within the
cut's spill goes to both sides. Direction, cut and spill are chosen per node on a sample of its
vectors: the cheapest split that loses no more links than the node may. A tree may lose the share
``LOSS`` of the links from root to leaf, whatever its depth, so with independent trees
1 - ``LOSS`` ** trees of them are found. Lost links are counted among the sample's own; few of
those are filled up by what the density at the cut would lose. A node is a leaf when it is small,
or when no split is cheaper than comparing it whole, as in dense clouds. A label that one tree
compares whole is left out of the other trees. Leaves that are still large are compared in blocks,
each pair of blocks in a task of its own: exact, and quadratic in the size of a dense cloud.

Inside a leaf all pairs are compared in double precision, exactly. A pair is counted in the
first leaf that both vectors share, so counts are right however many leaves share it. Out of a
leaf come counts and links to the smallest vector of each local component, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import erfc, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.llm.common import components, staged
from verbarium.operators.numbering import number_rows
from verbarium.session import scratch_path

COSINE = 0.93
TREES = 4
LEAF = 512
# Vectors of a node by which its split is chosen, and links among them.
SAMPLE = 512
SAMPLE_LINKS = 4000
SAMPLE_GRAIN = 1 << 40
# Share of the links that a tree may lose, and how many sampled links the density's estimate counts for.
LOSS = 0.3
PRIOR = 30
# Half the overlap, as shares of the distance of a pair at the threshold; places of the cuts.
SPILLS = (0.32, 0.45, 0.6, 0.8, 1.0, 1.3)
CUTS = (0.3, 0.4, 0.5, 0.6, 0.7)
# Most pairs in the two sides of a split, as a share of the node's; logarithm by which a level shrinks a node.
GAIN = 0.9
SHRINK = 0.5
LEVELS = 8


@cache
def directions(tree: int, first_level: int, dimensions: int) -> np.ndarray:
    """``LEVELS`` random directions of a tree, of length sqrt(dimensions) on average."""
    rng = np.random.default_rng((tree, first_level, dimensions))
    return rng.standard_normal((LEVELS, dimensions))


def unit(values: list | None) -> bytes | None:
    """The direction of a vector as doubles, in bytes; None if it has none."""
    if not values or None in values:
        return None
    v = np.array(values, np.float64)
    largest = np.abs(v).max()
    if not np.isfinite(largest) or largest == 0:
        return None
    v /= largest  # so that squares neither overflow nor vanish
    return (v / np.sqrt((v * v).sum())).tobytes()


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, ``v`` and dim of every row; ``v`` is null where a row can't link."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    label_kind = vectors.schema["label"].dataType.simpleString()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, out, dims = [], [], [], []
            columns = (batch.column(i).to_pylist() for i in range(3))
            for vec_id, label, values in zip(*columns, strict=True):
                v = None if label is None else unit(values)
                row = (vec_id, label, v, None if v is None else len(v) // 8)
                for column, value in zip((ids, labels, out, dims), row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column(0).type), pa.array(labels, batch.column(1).type), pa.array(out, pa.binary()), pa.array(dims, pa.int32())],
                names=["vec_id", "label", "v", "dim"],
            )

    return vectors.select("vec_id", "label", "embedding").mapInArrow(over, f"vec_id {kind}, label {label_kind}, v binary, dim int")


def projected(classes: DataFrame, places: DataFrame | None, first_level: int, trees: int) -> DataFrame:
    """(id, tree, node, root, left, p): projections of each vector on the next levels' directions.

    ``root`` is the label's, ``left`` the share of links that may still be lost.
    """
    if places is None:
        start = classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        start = start.select(
            "id", "v", "tree", F.xxhash64("tree", "label", "dim").alias("node"), F.xxhash64("label", "dim").alias("root"), F.lit(LOSS).alias("left")
        )
    else:
        start = classes.select("id", "v").join(places, "id").select("id", "v", "tree", "node", "root", "left")
    names = ["id", "tree", "node", "root", "left"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v, tree in zip(batch.column("v").to_pylist(), batch.column("tree").to_pylist(), strict=True):
                x = np.frombuffer(v)
                rows.append(directions(tree, first_level, len(x)) @ x)
            flat = np.concatenate(rows) if rows else np.zeros(0)
            p = pa.FixedSizeListArray.from_arrays(pa.array(flat), LEVELS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), p], names=[*names, "p"])

    return start.mapInArrow(over, "id long, tree int, node long, root long, left double, p array<double>")


def beyond(x: float) -> float:
    """Mean of what a standard normal's absolute value exceeds ``x`` by."""
    return 2 * (exp(-x * x / 2) / sqrt(2 * pi) - x * erfc(x / sqrt(2)) / 2)


def best_split(v: np.ndarray, p: np.ndarray, n: int, left: float, cosine: float, leaf: int) -> tuple[int, float, float, float] | None:
    """Direction, cut, spill and lost share of the split of a node of ``n`` vectors; None for a leaf.

    ``v`` and ``p``: vectors and projections of its sample.
    """
    reach = sqrt(2 - 2 * cosine)
    allowed = left / max(1.0, log(n / leaf) / SHRINK)
    i, j = np.nonzero(np.triu(v @ v.T >= cosine, 1))
    if len(i) > SAMPLE_LINKS:
        some = np.random.default_rng(0).choice(len(i), SAMPLE_LINKS, replace=False)
        i, j = i[some], j[some]
    best = None
    for axis in range(p.shape[1]):
        x = p[:, axis]
        low, high = np.minimum(x[i], x[j]), np.maximum(x[i], x[j])
        for cut in np.quantile(x, CUTS).tolist():
            density = (np.abs(x - cut) <= reach).mean() / (2 * reach)
            for share in SPILLS:
                spill = share * reach
                cost = (x <= cut + spill).mean() ** 2 + (x > cut - spill).mean() ** 2
                if cost >= GAIN:
                    break
                lost = ((low <= cut - spill) & (high > cut + spill)).sum()
                loss = (lost + PRIOR * density * reach * beyond(2 * share)) / (len(i) + PRIOR)
                if loss <= allowed:
                    if best is None or cost + loss < best[0]:
                        best = (cost + loss, axis, cut, spill, loss)
                    break
    return best and best[1:]


def node_splits(state: DataFrame, classes: DataFrame, cosine: float, leaf: int) -> DataFrame:
    """(node, axis, cut, spill, loss) of the nodes that are split."""
    sizes = state.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > leaf)
    place = F.xxhash64("id", "node").bitwiseAND(SAMPLE_GRAIN - 1) / F.lit(float(SAMPLE_GRAIN))
    sampled = state.join(sizes, "node").where(place < F.lit(float(SAMPLE)) / F.col("n")).select("id", "node", "n", "left", "p")
    sampled = sampled.join(classes.select("id", "v"), "id")

    def task(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        v = np.frombuffer(b"".join(group["v"].to_pylist())).reshape(len(group), -1)
        p = np.array(group["p"].to_pylist())
        found = best_split(v, p, group["n"][0].as_py(), group["left"][0].as_py(), cosine, leaf)
        rows = [] if found is None else [(group["node"][0].as_py(), *found)]
        kinds = {"node": pa.int64(), "axis": pa.int32(), "cut": pa.float64(), "spill": pa.float64(), "loss": pa.float64()}
        return pa.table({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(kinds.items())})

    return sampled.groupBy("node").applyInArrow(task, "node long, axis int, cut double, spill double, loss double")


def forest(classes: DataFrame, cosine: float, trees: int, leaf: int) -> DataFrame:
    """(id, leaf): the leaves of every vector in all trees.

    Each level is one count, one choice on samples of bounded size, and one join.
    """
    done: list[DataFrame] = []
    level = 0
    places: DataFrame | None = None
    while True:
        if level % LEVELS == 0:
            state = staged(projected(classes, places, level, trees), "forest")
        splits = staged(node_splits(state, classes, cosine, leaf), "splits")
        cut = staged(state.join(splits, "node", "left").withColumn("at", F.get("p", F.col("axis"))), "forest")
        if level == 0:
            # Labels that a tree compares whole need no other tree.
            whole = cut.where("cut IS NULL").groupBy("root").agg(F.min("tree").alias("only"))
            cut = cut.join(whole, "root", "left").where("only IS NULL OR only = tree")
        done.append(cut.where("cut IS NULL").select("id", "tree", F.col("node").alias("leaf")))
        rest = cut.where("cut IS NOT NULL")
        if rest.isEmpty():
            break
        low, high = F.col("at") <= F.col("cut") + F.col("spill"), F.col("at") > F.col("cut") - F.col("spill")
        sides = F.array_compact(F.array(F.when(low, 0), F.when(high, 1)))
        child = F.xxhash64("node", F.lit(level), "side")
        state = rest.withColumn("side", F.explode(sides)).select(
            "id", "tree", child.alias("node"), "root", (F.col("left") - F.col("loss")).alias("left"), "p"
        )
        places = state.select("id", "tree", "node", "root", "left")
        level += 1
    leaves = done[0]
    for more in done[1:]:
        leaves = leaves.union(more)
    return leaves.select("id", "leaf")


def compare(batch: pa.Table, cosine: float) -> dict[str, np.ndarray]:
    """Counts and local components of one leaf, or of two blocks of a leaf.

    Columns: id, v, n (vectors of this class), leaves (all of its leaves, sorted), leaf, own
    (block), a and b (the blocks of this task).
    """
    order = np.argsort(batch["id"].to_numpy())
    ids = batch["id"].to_numpy()[order]
    weight = batch["n"].to_numpy()[order]
    own = batch["own"].to_numpy()[order]
    a, b = batch["a"][0].as_py(), batch["b"][0].as_py()
    leaf = batch["leaf"][0].as_py()
    v = np.frombuffer(b"".join(batch["v"].to_pylist())).reshape(len(ids), -1)[order]
    linked = v @ v.T >= cosine
    np.fill_diagonal(linked, False)
    if a != b:  # pairs inside one block belong to another task
        linked &= own[:, None] != own[None, :]
    # Whether a smaller leaf holds both vectors.
    leaves = batch["leaves"].to_pylist()
    leaves = [leaves[i] for i in order.tolist()]
    earlier = sorted({x for row in leaves for x in row if x < leaf})
    number = {x: i for i, x in enumerate(earlier)}
    member = np.zeros((len(ids), len(earlier)), np.float32)
    for i, row in enumerate(leaves):
        for x in row:
            if x < leaf:
                member[i, number[x]] = 1
    first = linked & ~(member @ member.T > 0)
    found = first @ weight
    roots = np.arange(len(ids))
    busy = np.flatnonzero(linked.any(1))
    inner = linked[np.ix_(busy, busy)]
    label = busy.copy()
    while len(busy):
        lowest = np.where(inner, label[None, :], len(ids)).min(1)
        new = np.minimum(label, lowest)
        if (new == label).all():
            break
        label = new
    roots[busy] = label
    used = linked.any(1)
    return {"id": ids[used], "found": found[used].astype(np.int64), "root": ids[roots][used]}


def leaf_links(classes: DataFrame, cosine: float, trees: int, leaf: int) -> DataFrame:
    """(id, found, root) per leaf and vector that has links there."""
    leaves = staged(forest(classes, cosine, trees, leaf), "leaves")
    sizes = leaves.groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1")
    every = leaves.groupBy("id").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    placed = leaves.join(sizes, "leaf").join(every, "id").join(classes.select("id", "v", "n"), "id")
    blocks = F.ceil(F.col("size") / (2 * leaf)).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = placed.withColumn("other", other).select(
        "id", "v", "n", "leaves", "leaf", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")
    )

    def task(group: pa.Table) -> pa.Table:
        return pa.table(compare(group, cosine))

    return paired.groupBy("leaf", "a", "b").applyInArrow(task, "id long, found long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a
    label, link with nothing; vectors of different lengths have no cosine. Equal vectors under
    one label are one class with a count. Rows with a null vec_id link like any other and never
    name a component; they are kept only if no named vector is in their component. Rows that
    repeat a vec_id count as vectors of their own. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    every = staged(unit_vectors(vectors), "vectors")
    rows = every.where("v IS NOT NULL")
    grouped = rows.groupBy("label", "dim", "v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    classes = number_rows(grouped, scratch_path(spark, "classes"))
    found = staged(leaf_links(classes, cosine, trees, leaf), "leaf-links")
    counts = found.groupBy("id").agg(F.sum("found").alias("others"))
    edges = staged(found.select(F.col("id").alias("a"), F.col("root").alias("b")).distinct(), "vector-links")
    joined = components(edges, "vector-rounds").withColumnRenamed("node", "id")
    known = classes.drop("v", "dim", "label").join(counts, "id", "left").join(joined, "id", "left")
    known = known.withColumn("component", F.coalesce("component", "id"))
    names = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = known.join(names, "component").select("id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    member = classes.select("id", "label", "dim", "v")
    linked = rows.join(member, ["label", "dim", "v"]).join(named, "id").select("vec_id", "n_links", "component_id")
    alone = every.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.col("vec_id").eqNullSafe(F.col("component_id"))
    return linked.union(alone).withColumn("kept", kept)
