"""Dense surrogate ids without a single-task ranking."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.session import stage

# monotonically_increasing_id keeps the row's place in its partition in the low 33 bits.
PLACE_MASK = (1 << 33) - 1


def number_rows(
    df: DataFrame, path: str, start: int = 0, order: list[str] | None = None
) -> DataFrame:
    """Add ``id``: start + 1, start + 2, ... over the whole table.

    With ``order`` (unique values) the ids follow that order, otherwise they follow the layout
    of ``df``. Each row's place is written out once with the rows, to ``path``, so every later
    read sees the same ids whatever executors are lost; only one count per partition is ranked.
    """
    return numbered(df, path, start, order)[0]


def numbered(
    df: DataFrame, path: str, start: int = 0, order: list[str] | None = None
) -> tuple[DataFrame, int]:
    """The same and the last id, ``start`` for an empty table."""
    laid_out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    placed = stage(
        laid_out.withColumn("_part", F.spark_partition_id()).withColumn(
            "_place", F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE_MASK))
        ),
        path,
    )
    # One row per partition written: bounded by the number of tasks, not by the data.
    sizes = dict(map(tuple, placed.groupBy("_part").count().collect()))
    before = list(accumulate((sizes.get(part, 0) for part in range(max(sizes, default=-1) + 1)), initial=start))
    # One constant, however many partitions there are.
    offsets = F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")
    ids = F.get(offsets, F.col("_part")) + F.col("_place") + F.lit(1)
    return placed.select(ids.alias("id"), *df.columns), before[-1]
