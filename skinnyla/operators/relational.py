"""Matrix algebra as joins and sums over (i, j, val) rows, for sparse matrices of any shape, and products of dense rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "val")


def gemm(a: DataFrame, b: DataFrame, a_transposed: bool = False, b_transposed: bool = False) -> DataFrame:
    """op(A) op(B): an equi-join on the inner index, summed with partial aggregates."""
    a, b = transpose(a) if a_transposed else a, transpose(b) if b_transposed else b
    left = a.select("i", F.col("j").alias("k"), F.col("val").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("val").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("val"))


def add(*parts: DataFrame) -> DataFrame:
    """The elementwise sum of matrices."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("i", "j").agg(F.sum("val").alias("val"))


def nonzero(a: DataFrame) -> DataFrame:
    return a.where(F.col("val") != 0)


def upper(a: DataFrame) -> DataFrame:
    """The packed form: the upper triangle."""
    return a.where("i <= j")


def mirror(a: DataFrame) -> DataFrame:
    """The symmetric matrix of an upper triangle."""
    return a.unionByName(transpose(a.where("i < j")))


def block_products(rows: DataFrame, left: str, right: str, names: tuple[str, str], upper_only: bool) -> DataFrame:
    """Sums of left^T right over rows of two array columns: a product a batch, a matrix a task, summed by Spark.

    Columns of left that are 0 in all rows of a task give nothing there.
    """

    def run(batches):
        total = used = None
        for b in batches:
            if b.num_rows:
                x, y = (c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1) for c in b.columns)
                used = (x != 0).any(axis=0) if used is None else used | (x != 0).any(axis=0)
                total = x.T @ y if total is None else total + x.T @ y
        if total is not None:
            i, j = np.nonzero(np.triu(np.ones(total.shape, bool)) if upper_only else np.broadcast_to(used[:, None], total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=[*names, "val"])

    i, j = names
    both = rows.select(F.col(left).cast("array<double>").alias("x"), F.col(right).cast("array<double>").alias("y"))
    return both.mapInArrow(run, f"{i} int, {j} int, val double").groupBy(i, j).agg(F.sum("val").alias("val"))


def gram(rows: DataFrame, vector: str = "v") -> DataFrame:
    """(i, j, val) of V^T V's upper triangle for rows of arrays."""
    return block_products(rows, vector, vector, ("i", "j"), True)


def whole_products(rows: DataFrame, left: str, right: str) -> DataFrame:
    """(i, j, val) of left^T right over rows of two array columns of whole numbers below 10^19, as exact decimals.

    Doubles round sums beyond 2^53. Nulls are left out of a sum, which is null if nothing else is in it.
    """
    x = rows.select(F.posexplode(F.col(left).cast("array<decimal(19,0)>")).alias("i", "x"), F.col(right).cast("array<decimal(19,0)>").alias("right"))
    both = x.select("i", "x", F.posexplode("right").alias("j", "y"))
    return both.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("val"))


def outer_sum(rows: DataFrame, left: str, right: str) -> DataFrame:
    """(col_id, s, val) of sum left^T right over rows: what each row adds to A^T Q."""
    return block_products(rows, left, right, ("col_id", "s"), False)


def times_columns(coo: DataFrame, bt: DataFrame) -> DataFrame:
    """(row_id, s, val) of A Bt from A's elements and (col_id, s, val); elements without a row of Bt drop out."""
    b = bt.select("col_id", "s", F.col("val").alias("y"))
    return coo.join(b, "col_id").groupBy("row_id", "s").agg(F.sum(F.col("val") * F.col("y")).alias("val"))
