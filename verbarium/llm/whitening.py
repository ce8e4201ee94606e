"""Whitening of embeddings with block matrices.

Rows are numbered, centred and laid into a BlockMatrix X of blocks of ``ROWS`` rows. The scatter
is X'X: the transposed blocks are placed in a tall matrix, each group of ``GROUP`` blocks in block
rows of its own, so that the product is dealt out by group and not made in one task; the groups'
parts are added in Spark. Only the scatter, a square of the vectors' length, comes to the driver,
where its eigenvectors give the whitening matrix; X times it projects the rows.

Sums and deviations are whole numbers, so they are added as such, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, LongType, StructField, StructType

from verbarium.llm.common import staged
from verbarium.operators.numbering import number_rows
from verbarium.session import scratch_path

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
ROWS = 1024
GROUP = 16
# Shares of the largest eigenvalue below which a component counts as without variance.
FLAT = 1e-12
LARGEST = 1 << 62


def whole(entry: Column) -> Column:
    """The entry as a whole number; what no long can hold stops at 2^62."""
    scaled = F.floor(entry.cast("double") * SCALE)
    return (F.least(F.greatest(scaled, F.lit(-LARGEST)), F.lit(LARGEST)) + OFFSET).cast("long")


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and ``x`` of the vectors that have the table's most common length, the longer at a tie."""
    sound = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    )
    rows = vectors.where(sound).select("vec_id", F.transform("embedding", whole).alias("x"))
    sizes = rows.where(F.size("x") > 0).groupBy(F.size("x").alias("size")).count()
    usual = sizes.orderBy(F.desc("count"), F.desc("size")).limit(1).select("size").first()
    return rows.where(F.size("x") == F.lit(usual["size"] if usual else -1))


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def small(x: np.ndarray, factor: int) -> bool:
    """Whether ``factor`` times any entry fits into a long."""
    return not x.size or max(abs(int(x.min())), abs(int(x.max()))) * factor < LARGEST


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch, "x")
                n += len(x)
                sums = sums + (x if small(x, len(x)) else x.astype(object)).sum(0).astype(object)
        if n:
            kind = pa.decimal128(38, 0)
            columns = [pa.array([n] * len(sums), pa.int64()), pa.array(range(len(sums)), pa.int32()), pa.array(map(Decimal, sums), kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "dim", "s"])

    parts = rows.select("x").mapInArrow(over, "n long, dim int, s decimal(38,0)")
    by_dim = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").cast(DecimalType(38, 0)).alias("s"))
    found = by_dim.orderBy("dim").collect()  # one row per dimension
    return (found[0]["n"] if found else 0), [int(r["s"]) for r in found]


def centred(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """id, vec_id, deviation and centred values of every row."""
    most = max([n, *map(abs, sums)])
    schema = StructType(
        [
            StructField("id", LongType()),
            rows.schema["vec_id"],
            StructField("deviation", LongType()),
            StructField("row", ArrayType(DoubleType())),
        ]
    )

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch, "x")
            fits = small(x, n) and most < LARGEST
            apart = (x if fits else x.astype(object)) * n - np.array(sums, np.int64 if fits else object)
            if small(apart, 1) and max(abs(int(apart.min())), abs(int(apart.max()))) ** 2 * apart.shape[1] < LARGEST:
                deviation = (apart.astype(np.int64) ** 2).sum(1).tolist()
            else:
                exact = [sum(int(a) ** 2 for a in row) for row in apart.tolist()]
                deviation = [d if d < 1 << 63 else None for d in exact]
            values = (apart / n).astype(np.float64)
            ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))
            columns = [batch.column("id"), batch.column("vec_id"), pa.array(deviation, pa.int64()), listed]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select("id", "vec_id", "x").mapInArrow(over, schema)


class Blocks:
    """Rows (id from 1, an array of ``width`` numbers) as staged blocks of ``ROWS`` rows."""

    def __init__(self, rows: DataFrame, values: str, n: int, width: int, name: str):
        numbered = rows.select(F.floor((F.col("id") - 1) / ROWS).cast("int").alias("block"), "id", F.col(values).alias("row"))
        lines = F.sort_array(F.collect_list(F.struct("id", "row")))
        flat = F.flatten(F.transform(lines, lambda line: line["row"]))
        self.table = staged(numbered.groupBy("block").agg(flat.alias("numbers")), name)
        self.n, self.width, self.step = n, width, min(width, ROWS)
        self.down, self.across = -(-n // ROWS), -(-width // self.step)

    def cut(self, place) -> RDD:
        """Blocks as ``place`` makes them of (row of blocks, column of blocks, numbers)."""
        width, step = self.width, self.step

        def cut_row(row):
            numbers = np.array(row["numbers"]).reshape(-1, width)
            return [place(row["block"], j, numbers[:, j * step : (j + 1) * step]) for j in range(-(-width // step))]

        return self.table.rdd.flatMap(cut_row)

    def matrix(self) -> BlockMatrix:
        """X."""
        blocks = self.cut(lambda i, j, x: ((i, j), Matrices.dense(*x.shape, x.ravel(order="F"))))
        return BlockMatrix(blocks, ROWS, self.step, self.n, self.width)

    def spread_transpose(self) -> BlockMatrix:
        """X', the blocks of each group of ``GROUP`` in block rows of their own."""
        across = self.across
        blocks = self.cut(lambda i, j, x: ((i // GROUP * across + j, i), Matrices.dense(*x.T.shape, x.ravel())))
        tall = -(-self.down // GROUP) * across * self.step
        return BlockMatrix(blocks, self.step, ROWS, tall, self.n)

    def scatter(self) -> np.ndarray:
        """X'X."""
        across, step = self.across, self.step
        product = self.spread_transpose().multiply(self.matrix())
        parts = product.blocks.map(lambda b: ((b[0][0] % across, b[0][1]), b[1].toArray()))
        out = np.zeros((self.width, self.width))
        for (i, j), part in parts.reduceByKey(lambda a, b: a + b).collect():  # width x width numbers
            out[i * step : i * step + part.shape[0], j * step : j * step + part.shape[1]] = part
        return out

    def projected(self, weights: np.ndarray) -> BlockMatrix:
        """X times the weights."""
        cuts = [(i, weights[i * self.step : (i + 1) * self.step]) for i in range(self.across)]
        blocks = [((i, 0), Matrices.dense(*w.shape, w.ravel(order="F"))) for i, w in cuts]
        context = self.table.sparkSession.sparkContext
        return self.matrix().multiply(BlockMatrix(context.parallelize(blocks, len(blocks)), self.step, weights.shape[1], *weights.shape))


def rows_of(matrix: BlockMatrix) -> RDD:
    """(id from 1, numbers) of the rows of a matrix that is one block wide."""

    def lines(block):
        (i, _), values = block
        return [(i * ROWS + k, row) for k, row in enumerate(values.toArray().tolist(), 1)]

    return matrix.blocks.flatMap(lines)


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, the largest entry of each above zero."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    largest = np.abs(vectors).argmax(0)
    return values, vectors * np.where(vectors[largest, np.arange(len(vectors))] < 0, -1.0, 1.0)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, a row per vector
    and component.

    Vectors that are null or hold null or non-finite entries are left out, and so are those,
    empty ones too, that do not have the table's most common length (at a tie the longer), since
    they share no covariance with the others. Null and repeated vec_ids and equal vectors are
    rows of their own. A component without variance, as in a table of fewer vectors than
    dimensions, cannot be whitened: its ``whitened`` is null, its ``explained`` 0, and the error
    is taken over the others. A deviation that no long can hold is null. An empty table has no
    rows. Other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    rows = number_rows(usable(vectors), scratch_path(spark, "whitening-rows"))
    n, sums = totals(rows)
    dims = len(sums)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return spark.createDataFrame([], schema)
    laid = staged(centred(rows, n, sums), "whitening-centred")
    x = Blocks(laid, "row", n, dims, "whitening-blocks")
    values, axes = eigen(x.scatter() / n)
    kept = int((values[:components] > values[0] * FLAT).sum())
    shares = (values / values.sum() if kept else values * 0.0)[:components].tolist()

    error, done = 0.0, None
    if kept:
        pairs = rows_of(x.projected(axes[:, :kept] / np.sqrt(values[:kept])))
        done = staged(spark.createDataFrame(pairs, "id long, whitened array<double>"), "whitening-projected")
        covariance = Blocks(done, "whitened", n, kept, "whitened-blocks").scatter() / n
        error = float(np.abs(covariance - np.eye(kept)).max())
    else:
        done = laid.select("id", F.array().cast("array<double>").alias("whitened"))
    explained = F.array(*[F.lit(s if i < kept else 0.0) for i, s in enumerate(shares)])
    numbers = F.explode(F.sequence(F.lit(1), F.lit(len(shares)))).alias("component")
    return (
        laid.select("id", "vec_id", "deviation")
        .join(done, "id")
        .select("vec_id", "deviation", "whitened", numbers)
        .select(
            "vec_id",
            "component",
            F.lit(n).cast("long").alias("n"),
            "deviation",
            F.get("whitened", F.col("component") - 1).alias("whitened"),
            F.get(explained, F.col("component") - 1).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )
