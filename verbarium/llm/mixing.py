"""Mixing sources to target weights: nested budget thresholds from hash histograms.

Every document has a fixed 60-bit hash. A source's budget is met by the documents whose hash is
below a threshold, so a smaller budget always takes a subset of what a larger one takes. The
threshold comes from histograms: words are summed by source and hash cell, the cell in which the
running sum meets the budget is refined by the next bits, and so on until it holds one document.
Documents that share a hash, such as copies or rows without an id, are told apart by further keys
in the same way: a hash of the text, then a number per row. Nothing is sorted but the cells of one
source, at most ``CELLS`` per budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbarium.llm.common import staged, word_count

# Keys of the order in which documents are taken, each of ``HASH_BITS`` bits.
KEYS = ("h", "t", "u")
HASH_BITS = 60
CELL_BITS = 12
CELLS = 1 << CELL_BITS
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def place_hash(doc_id: Column, size: Column) -> Column:
    """A 60-bit number that only depends on the document."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), size.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def measured(docs: DataFrame, *kept: Column) -> DataFrame:
    """doc_id, source, size (words) and the keys of every row, and ``kept``.

    The number per row is fixed once the result is staged.
    """
    size, mask = word_count(F.col("text")), (1 << HASH_BITS) - 1
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(mask))
    sized = docs.select("doc_id", "source", size.alias("size"), text_hash.alias("t"), F.monotonically_increasing_id().alias("u"), *kept)
    return sized.withColumn("h", place_hash(F.col("doc_id"), F.col("size")))


def targets(rows: DataFrame) -> DataFrame:
    """source, source_size and target of every source.

    Sources by code point, null last, have the weights 3, 1, 2, 3, ... and share 1.5 times all
    words. A target stops at twice its source's size; the excess is shared anew by weight until
    none is above. Sorted by capacity per weight, the sources that are full form a prefix: one
    is full if its capacity is not above its share of what those before it have left. The
    windows run over one row per source.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    weighed = sizes.select("source", "source_size", weight.cast("double").alias("w"))
    weighed = weighed.withColumn("capacity", (F.col("source_size") * MOST).cast("double"))
    everything = Window.partitionBy()
    weighed = weighed.select(
        "*",
        (F.sum("source_size").over(everything) * SHARE).alias("budget"),
        F.sum("w").over(everything).alias("all_w"),
    )
    order = Window.orderBy(F.col("capacity") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum("capacity").over(before), F.lit(0.0))
    used = F.coalesce(F.sum("w").over(before), F.lit(0.0))
    full = F.col("capacity") * (F.col("all_w") - used) <= F.col("w") * (F.col("budget") - taken)
    weighed = weighed.withColumn("full", full)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(everything), F.lit(0.0))
    left_w = F.col("all_w") - F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(everything), F.lit(0.0))
    target = F.when(F.col("full"), F.col("capacity")).otherwise(left * F.col("w") / left_w)
    return weighed.select("source", "source_size", target.alias("target"))


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, k and ``below`` (a number per key): the rows of the source whose keys, in their
    order, are below it meet budget ``k``.

    ``budgets``: source, k, budget. The document at the boundary belongs to it if the sum comes
    closer with it.
    """
    fixed: list[Column] = []
    state = budgets.select("source", "k", F.col("budget").cast("double").alias("rest"), F.lit(0).cast("long").alias("prefix"))
    per_budget = Window.partitionBy("source", "k").orderBy("cell")
    for key in KEYS:
        shift, names = HASH_BITS, [f"at_{c}" for c in KEYS[: len(fixed)]]
        while shift > 0:
            cell_shift = shift - CELL_BITS
            state = state.withColumnRenamed("source", "s")
            here = same("source", "s") & (F.shiftright(key, shift) == F.col("prefix"))
            for c, name in zip(KEYS, names):
                here &= F.col(c) == F.col(name)
            inside = rows.join(state, here)
            cells = inside.groupBy("source", "k", "rest", *names, F.shiftright(key, cell_shift).alias("cell")).agg(
                F.sum("size").alias("words"), F.count("*").alias("n")
            )
            summed = cells.withColumn("upto", F.sum("words").over(per_budget))
            # The first cell that meets the budget, or the last one if none does.
            meets = (F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest"))
            ends = F.row_number().over(Window.partitionBy("source", "k").orderBy(F.col("cell").desc())) == 1
            boundary = summed.withColumn("last", ends).where(meets | (F.col("last") & (F.col("upto") < F.col("rest"))))
            rest = (F.col("rest") - F.col("upto") + F.col("words")).alias("rest")
            state = staged(boundary.select("source", "k", rest, *names, F.col("cell").alias("prefix"), "words", "n"), "thresholds")
            shift = cell_shift
            if not (state.agg(F.max("n")).first()[0] or 0) > 1:
                # A single document left in a cell: its whole cell decides like its keys.
                takes = F.col("words") - F.col("rest") <= F.col("rest")
                edge = F.shiftleft(F.col("prefix") + F.when(takes, 1).otherwise(0), shift)
                none = [F.lit(0).cast("long")] * (len(KEYS) - len(fixed) - 1)
                below = F.struct(*(c.alias(k) for c, k in zip([*fixed, edge, *none], KEYS)))
                return state.select("source", "k", below.alias("below"))
            state = state.drop("words", "n")
        state = state.withColumnRenamed("prefix", f"at_{key}").withColumn("prefix", F.lit(0).cast("long"))
        fixed.append(F.col(f"at_{key}"))
    raise ValueError("rows share all their keys")


def mix_plan(rows: DataFrame) -> DataFrame:
    """source, source_size, target, below1 and below2 of every source.

    A document is taken once if its hash is below the first threshold and once more if it is
    below the second; the second budget is what the target has beyond the source's size.
    """
    goals = staged(targets(rows), "targets")
    size = F.col("source_size").cast("double")
    budget = lambda k: F.least(F.greatest(F.col("target") - size * k, F.lit(0.0)), size)
    budgets = goals.select("source", F.posexplode(F.array(budget(0), budget(1))).alias("k", "budget"))
    found = thresholds(rows, budgets.where("budget > 0"))
    pivoted = found.groupBy(F.col("source").alias("s")).agg(
        *(F.max(F.when(F.col("k") == k, F.col("below"))).alias(f"below{k + 1}") for k in range(MOST))
    )
    joined = goals.join(pivoted, same("source", "s"), "left")
    return staged(joined.select("source", "source_size", "target", "below1", "below2"), "mix")


def copies() -> Column:
    """How often the mix takes a row; a source without a threshold takes none."""
    keys = F.struct(*KEYS)
    return sum((F.coalesce(keys < F.col(f"below{k + 1}"), F.lit(False)).cast("int") for k in range(MOST)), F.lit(0))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row of ``docs``.

    A null text has size 0; documents without a source are a source of their own, the last one.
    Each row is taken for itself, also where others share its doc_id, size and text: which of
    them are taken is then open, but not how many. Texts of any length count whole. An empty
    table gives an empty result. Columns beside doc_id, source and text do not matter.
    """
    rows = staged(measured(docs), "measured")
    plan = mix_plan(rows).withColumnRenamed("source", "s")
    return rows.join(plan, same("source", "s")).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (copies() * F.col("size")).cast("long").alias("taken"),
        copies().alias("copies"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with all their columns, repeated as often as taken.

    Nulls, equal rows, long texts and empty tables: see ``mix``. Columns of any name stay as they
    are. The rows are staged once, so that their numbers hold.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = staged(measured(docs, whole), "measured")
    plan = mix_plan(rows).withColumnRenamed("source", "s")
    joined = rows.join(plan, same("source", "s")).select("row", copies().alias("times"))
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")
