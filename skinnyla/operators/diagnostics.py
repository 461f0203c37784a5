"""Checks of a factorisation, and matrices as text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skinnyla.functions.scalar import block_of
from skinnyla.operators.qr import QR, stack
from skinnyla.sources.matrices import Matrix


def residual(a: Matrix, qr: QR, sub_rows: int | None = None) -> DataFrame:
    """(block_id, mean_abs): the mean of ||A| - |QR|| over each block of rows, 0 if the factors are right.

    A row of A or Q whose id the other does not have is an error.
    """
    n, r = a.columns, qr.matrix

    def run(batches):
        for b in batches:
            if b.num_rows:
                gap = np.abs(np.abs(stack(b.column(1), n)) - np.abs(stack(b.column(2), n) @ r)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gap)], names=["row_id", "gap"])

    both = a.rows.join(qr.q(), "row_id", "full").select("row_id", "v", "q").mapInArrow(run, "row_id long, gap double")
    block = block_of(F.col("row_id"), a.rows.count(), sub_rows or n)
    return both.groupBy(block.alias("block_id")).agg((F.sum("gap") / (F.count("*") * n)).alias("mean_abs"))


def orthogonality(qr: QR) -> float:
    """The largest entry of |Q^T Q - I|."""
    n = qr.columns

    def run(batches):
        total = np.zeros((n, n))
        for b in batches:
            q = stack(b.column(1), n)
            total += q.T @ q
        at = np.arange(n * n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["k", "val"])

    got = np.zeros(n * n)
    for x in qr.q().mapInArrow(run, "k long, val double").groupBy("k").agg(F.sum("val").alias("val")).collect():
        got[x.k] = x.val
    return float(np.abs(got.reshape(n, n) - np.eye(n)).max())


def dump(blocks: DataFrame, key: str = "block_id", digits: int | None = None) -> DataFrame:
    """(key, text) of blocks (m, n, data): a line of the key, one of the shape, and one for each row."""
    number = (lambda x: F.format_number(x, digits)) if digits is not None else (lambda x: x.cast("string"))
    line = lambda i: F.concat(F.array_join(F.transform(F.slice("data", i * F.col("n") + 1, F.col("n")), number), " "), F.lit(" "))
    lines = F.array_join(F.transform(F.sequence(F.lit(0), F.col("m") - 1), line), "\n")
    return blocks.select(key, F.concat(F.lit("key: "), F.col(key), F.lit("\nm "), F.col("m"), F.lit(", n "), F.col("n"), F.lit("\n"), lines).alias("text"))


def write_residual(a: Matrix, qr: QR, path: str, sub_rows: int | None = None) -> None:
    """The residuals as text: a block and its mean on each line, with a tab between."""
    rows = residual(a, qr, sub_rows).orderBy("block_id")
    rows.select(F.concat_ws("\t", F.col("block_id").cast("string"), F.col("mean_abs").cast("string")).alias("value")).write.mode("overwrite").text(path)
