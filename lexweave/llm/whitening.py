"""Whitening of embeddings with distributed block matrices.

Entries are taken as whole 256ths (x = floor(256 * c)), so sums and deviations are exact. The statistics are fitted on
each distinct vector once.

1. `fixed_point`: usable rows and their x. Shorter vectors count as followed by zeros.
2. Centred rows get gapless indices and become a BlockMatrix of `ROWS_PER_BLOCK` rows a block. Its transpose times itself
   is the scatter; the block products are summed in `splits` groups before they meet, as the result is one block.
3. The covariance has one entry per pair of dimensions; its eigenvectors are found on the driver (`MAX_DIMS` bounds it).
4. The centred rows of all rows, copies included, times the whitening matrix (eigenvectors over the roots of their
   eigenvalues) give the components; the distinct rows' own product gives the error of their covariance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.store import numbered, staged

SCALE = 256
ROWS_PER_BLOCK = 1024
MAX_DIMS = 8192
COMPONENTS = 4
#: Directions with less than this share of the largest eigenvalue have no whitened value: they are rounding.
LEAST_SHARE = 1e-12


def usable(vector: Column) -> Column:
    """True for vectors without null, NaN or infinite entries."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def fixed_point(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """rows with `x`, an array of whole numbers, without the rows that have no usable vector."""
    return rows.filter(usable(F.col(vector))).withColumn("x", F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale)))


@dataclass
class Whitening:
    """Fitted on n distinct vectors: per-dimension sums, eigenvectors (columns) by falling eigenvalue, total variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def _padded(x: Column, dims: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(dims) - F.size(x), F.lit(0))))


def block_matrix(rows: DataFrame, sums: list[int], n: int) -> BlockMatrix:
    """The centred rows of (at, x) as a BlockMatrix; rows never pass through Python."""
    mean = F.lit([s / n for s in sums])
    centred = F.zip_with(_padded(F.col("x"), len(sums)), mean, lambda a, m: a.cast("double") - m)
    vectors = rows.select(F.col("at").alias("index"), array_to_vector(centred).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector")).toBlockMatrix(ROWS_PER_BLOCK, len(sums))


def product(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """left * right; `splits` groups of the inner blocks are multiplied apart, then added."""
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def scatter(matrix: BlockMatrix, splits: int) -> np.ndarray:
    """matrix' * matrix as a local array of dimensions by dimensions."""
    return product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def rows_of(matrix: BlockMatrix, name: str) -> DataFrame:
    """(at, name) of every row, as arrays of doubles."""
    held = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(held, "vector").select(F.col("index").alias("at"), vector_to_array("vector").alias(name))


def local(values: np.ndarray, spark) -> BlockMatrix:
    """A matrix of one block."""
    dense = Matrices.dense(*values.shape, values.ravel(order="F"))
    return BlockMatrix(spark.sparkContext.parallelize([((0, 0), dense)], 1), *values.shape)


def fit(points: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct x of `points` (x); None where there is no vector or no direction with any variance."""
    spark = points.sparkSession
    dims = points.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return None
    if dims > MAX_DIMS:
        raise ValueError(f"{dims} dimensions; the covariance of more than {MAX_DIMS} is not held on the driver")
    distinct = numbered(points.select(_padded(F.col("x"), dims).alias("x")).distinct(), "at", "distinct")
    n = distinct.count()
    found = dict(distinct.select(F.posexplode("x").alias("place", "value")).groupBy("place").agg(F.sum("value")).collect())
    sums = [int(found[i]) for i in range(dims)]
    splits = max(1, min(n // ROWS_PER_BLOCK, spark.sparkContext.defaultParallelism * 4))
    centred = block_matrix(distinct, sums, n)
    covariance = scatter(centred, splits) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    falling = np.argsort(-values, kind="stable")
    values, vectors = values[falling], vectors[:, falling]
    kept = min(components, int((values > LEAST_SHARE * max(values[0], 0)).sum()))
    if not kept:
        return None
    out = Whitening(n, sums, values[:kept], vectors[:, :kept], float(np.trace(covariance)), 0.0)
    white = product(centred, local(out.matrix, spark))
    out.identity_error = float(np.abs(scatter(white, splits) / n - np.eye(kept)).max())
    return out


def whitened(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """rows' other columns and x, n, deviation, whitened (array), explained (array), identity_error.

    Rows whose vector is null or holds a null, NaN or infinite entry are dropped; an empty vector is one of zeros, and
    shorter vectors are filled with zeros. Copies and equal ids each keep their row. deviation is null beyond 64 bits. There
    are at most `components` values, fewer where the vectors vary in fewer directions, and no row where they do not vary.
    """
    keep = [c for c in rows.columns if c != vector]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{vector}`").alias("_vector"))
    points = numbered(fixed_point(packed, "_vector").select("row", "x"), "at", "points")
    model = fit(points, components)
    if model is None:
        none = [F.lit(None).cast(t).alias(c) for c, t in
                (("n", "long"), ("deviation", "long"), ("whitened", "array<double>"), ("explained", "array<double>"), ("identity_error", "double"))]
        return points.filter(F.lit(False)).select("row", "x", *none)
    projected = rows_of(product(block_matrix(points, model.sums, model.n), local(model.matrix, rows.sparkSession)), "whitened")
    apart = lambda a, s: F.try_subtract(F.try_multiply(F.lit(model.n).cast("long"), a), s)
    squares = F.zip_with(_padded(F.col("x"), len(model.sums)), F.lit(model.sums).cast("array<long>"), lambda a, s: F.try_multiply(apart(a, s), apart(a, s)))
    deviation = F.aggregate(squares, F.lit(0).cast("long"), lambda t, s: F.try_add(t, s))
    return (points.join(staged(projected, "projected"), "at")
            .select("row", "x", F.lit(model.n).cast("long").alias("n"), deviation.alias("deviation"), "whitened",
                    F.lit([float(v / model.trace) for v in model.values]).alias("explained"), F.lit(model.identity_error).alias("identity_error")))
