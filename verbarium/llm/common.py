"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from verbarium.session import scratch_path, stage

# Words of a text: runs without ASCII white space. bytes.split() cuts at the same characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def make_importable(spark: SparkSession) -> None:
    """Let Python workers import this package also where only the driver's path names it."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        environment["PYTHONPATH"] = f"{known}:{root}".strip(":")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder of the shared scratch area, and read back."""
    return stage(df, scratch_path(df.sparkSession, name))


_tables: dict[tuple[str, str], object] = {}


def worker_table(key: tuple[str, str], make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks, made once per ``key``, until ``map_rows`` runs there."""
    if key not in _tables:
        _tables[key] = make()
    return _tables[key]


def release_tables() -> None:
    """Drop what earlier tasks left in this worker: its idle memory counts against the executor."""
    _tables.clear()


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def text_bytes(text: str = "text") -> Column:
    """The text as UTF-8 bytes, which Python tasks get without decoding; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def map_rows(
    df: DataFrame,
    work: Callable[[dict[str, list]], dict[str, list | pa.Array]],
    schema: str | StructType,
) -> DataFrame:
    """Apply ``work`` to each Arrow batch as lists by column; it returns the new columns."""
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow_schema = to_arrow_schema(target)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        for batch in batches:
            out = work({c: batch.column(c).to_pylist() for c in batch.schema.names})
            yield pa.RecordBatch.from_arrays(
                [as_array(out[f.name], f.type) for f in arrow_schema], schema=arrow_schema
            )

    return df.mapInArrow(over, target)


def as_array(values: list | pa.Array, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components: one row (node, component) per node of ``edges`` (a, b: long).

    The component is the smallest node reachable. Large-star and small-star steps alternate
    until a round changes nothing; each pulls every node towards the smallest node it sees,
    so the number of rounds grows with the logarithm of the longest path. All rows stay in
    Spark; every round is written to the shared scratch area, which cuts the lineage. A node
    with very many neighbours is an aggregation with a map-side combine and a join that the
    adaptive planner may split.
    """
    # Self loops keep isolated nodes in the result; they are put back at the end.
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    current = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        name,
    )
    before = None
    while True:
        both = current.union(current.select("b", "a"))
        lowest = both.groupBy("a").agg(F.min("b").alias("low"))
        lowest = lowest.select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        current = staged(small.union(low.select("a", F.col("low").alias("b"))).distinct(), name)
        # Row count and two sums over hashed rows tell whether the round changed the edges.
        mark = current.agg(
            F.count("*"),
            F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF)),
            F.sum(F.shiftright(F.xxhash64("b", "a"), 32)),
        ).first()
        if mark == before:
            break
        before = mark
    parent = current.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(parent.withColumnRenamed("a", "node"), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
