"""Whitening of vectors with distributed block matrices."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType

from veilspan.llm.common import Stored, column

ROWS_PER_BLOCK = 1024
# The places of all blocks go through the driver, so blocks grow once there are this many.
MOST_BLOCKS = 1 << 14
# Eigenvalues below this share of the largest are rounding, not variance.
NO_VARIANCE = 1e-12


class Whitened(NamedTuple):
    """What ``whiten`` found; everything but ``rows`` has a size that depends on the dimension alone."""

    rows: DataFrame  # the table's columns, and the whitened vector
    n: int
    sums: list  # exact for integers
    components: np.ndarray  # unit eigenvectors as columns, by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def is_finite(vector: Column) -> Column:
    """True for a vector that is not null and holds finite numbers alone."""
    return F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double"))
                               & (F.abs(v.cast("double")) < F.lit(float("inf")))), F.lit(False))


def blocks_of(rows: DataFrame, n: int, dim: int) -> BlockMatrix:
    """Rows ``at`` (0 to n-1, once each) with ``centred`` (array of double), as a block matrix."""
    vectors = MLUtils.convertVectorColumnsFromML(
        rows.select("at", array_to_vector("centred").alias("vector")), "vector")
    indexed = IndexedRowMatrix(callMLlibFunc("createIndexedRowMatrix", vectors, n, dim))
    # Read more than once: kept where it was made, and made again from the stored rows where it is lost.
    return indexed.toBlockMatrix(max(ROWS_PER_BLOCK, -(-n // MOST_BLOCKS)), dim).persist(
        StorageLevel.MEMORY_AND_DISK)


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """Transpose times matrix: a square of the dimension, summed over groups of row blocks."""
    n_blocks = -(-blocks.numRows() // blocks.rowsPerBlock)
    # Without splits every block would go to the one task that makes the result's only block.
    splits = max(1, min(n_blocks, int(n_blocks ** 0.5) * 4))
    product = blocks.transpose()._java_matrix_wrapper.call(
        "multiply", blocks._java_matrix_wrapper._java_model, splits)
    found = BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()
    return (found + found.T) / 2


def project(spark: SparkSession, blocks: BlockMatrix, matrix: np.ndarray) -> DataFrame:
    """Rows times a small local matrix: ``at`` and ``projected`` (array of double)."""
    rows, cols = matrix.shape
    right = BlockMatrix(spark.sparkContext.parallelize(
        [((0, 0), DenseMatrix(rows, cols, matrix.ravel(order="F")))], 1), rows, cols)
    indexed = blocks.multiply(right).toIndexedRowMatrix()
    table = callMLlibFunc("getIndexedRows", indexed._java_matrix_wrapper._java_model)
    return table.select(F.col("index").alias("at"),
                        vector_to_array(F.col("vector")).alias("projected"))


def _sums(rows: DataFrame, element: Column, dim: int) -> list:
    found = {r["pos"]: r["total"] for r in rows.select(F.posexplode("_x").alias("pos", "x"))
             .groupBy("pos").agg(F.sum(element).alias("total")).collect()}
    return [found[i] for i in range(dim)]


def whiten(df: DataFrame, vector_col: str = "vector", n_components: int | None = None,
           out_col: str = "whitened") -> Whitened | None:
    """Project every vector on the leading principal components, scaled to unit variance.

    Rows are numbered and centred exactly (integers by their whole and their remaining part of the
    mean), indexed as rows of a distributed block matrix, and multiplied with its transpose, which
    gives the covariance (divisor n). Its eigenvectors are found on the driver: a square of
    the dimension, however many rows there are. A product of the block matrix with the whitening
    matrix projects the rows, and the covariance of what came out is measured in the same way.

    Vectors take part if they are not null or empty, hold finite numbers alone, and have the most
    common length (of equally common ones the largest); other rows are left out. Repeated rows
    count as often as they stand there. Components without variance cannot be scaled and are
    left out, so equal vectors, or a single one, give empty results. Extra columns are passed on, but
    for one named like ``out_col``, which is replaced. None if no row takes part.
    """
    spark = df.sparkSession
    store = Stored(spark, "whitening")
    kept = [c for c in df.columns if c.lower() != out_col.lower()]
    integral = isinstance(df.schema[vector_col].dataType, ArrayType) and isinstance(
        df.schema[vector_col].dataType.elementType, IntegralType)
    x = column(vector_col).cast("array<long>" if integral else "array<double>")
    # Columns of the table lie in one struct, so that no name of theirs can clash.
    valid = df.filter(is_finite(column(vector_col)) & (F.size(column(vector_col)) > 0)).select(
        F.struct(*[column(c).alias(c) for c in kept]).alias("_row"), x.alias("_x"))
    lengths = valid.groupBy(F.size("_x").alias("dim")).count().orderBy(
        F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return None
    dim, n = lengths["dim"], lengths["count"]
    rows = _numbered(store, valid.filter(F.size("_x") == dim))
    sums = _sums(rows, F.col("x").cast("decimal(38,0)") if integral else F.col("x"), dim)
    if integral:
        sums = [int(s) for s in sums]
        whole = F.array(*[F.lit(s // n).cast("long") for s in sums])
        rest = F.array(*[F.lit((s % n) / n) for s in sums])
    else:
        whole = F.array(*[F.lit(s / n) for s in sums])
        rest = F.array(*[F.lit(0.0)] * dim)
    centred = F.zip_with(F.zip_with("_x", whole, lambda a, b: (a - b).cast("double")), rest,
                         lambda a, b: a - b)
    blocks = blocks_of(rows.select("at", centred.alias("centred")), n, dim)
    covariance = scatter(blocks) / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    trace = float(np.trace(covariance))
    take = int((values > NO_VARIANCE * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    take = min(take, dim if n_components is None else n_components)
    values, vectors = values[:take], vectors[:, :take]
    if not take:
        nothing = rows.select("_row.*", F.array().cast("array<double>").alias(out_col))
        return Whitened(nothing, n, sums, vectors, values, trace, 0.0)
    made = store.put(project(spark, blocks, vectors / np.sqrt(values)))
    mean = np.array(made.select(Summarizer.mean(array_to_vector("projected")).alias("m")).first()["m"])
    again = F.zip_with("projected", F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b)
    identity = scatter(blocks_of(made.select("at", again.alias("centred")), n, take)) / n
    out = rows.join(made, "at").select("_row.*", F.col("projected").alias(out_col))
    return Whitened(out, n, sums, vectors, values, trace,
                    float(np.abs(identity - np.eye(take)).max()))


def _numbered(store: Stored, rows: DataFrame) -> DataFrame:
    """Number the rows from 0 without gaps, in ``at``, by counting each stored part."""
    parts = store.put(rows.withColumn("_part", F.spark_partition_id())
                      .withColumn("_in", F.monotonically_increasing_id()))
    # One row for each task that wrote; the ids of a task begin at its number times 2^33.
    counts = parts.groupBy("_part").count().orderBy("_part").collect()
    bases, total = [], 0
    for r in counts:
        bases.append((r["_part"], total))
        total += r["count"]
    table = store.spark.createDataFrame(bases, "_part int, _base long")
    return parts.join(F.broadcast(table), "_part").select(
        (F.col("_base") + F.col("_in") % (1 << 33)).alias("at"), "_row", "_x")
