"""Stochastic singular value decomposition of rank k on top of the tall-and-skinny QR."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skinnyla.functions.hashing import SEED, omega
from skinnyla.functions.kernels import symmetric_eigen
from skinnyla.operators.qr import QR, stack, tsqr
from skinnyla.operators.sparse import SparseMatrix, sketched
from skinnyla.sources.matrices import Matrix


def sketch_dense(a: Matrix, right: np.ndarray) -> DataFrame:
    """(row_id, y) with y = v * right, a matrix of as many rows as a has columns."""
    n, k = right.shape

    def run(batches):
        for b in batches:
            if b.num_rows:
                y = stack(b.column(1), n) @ right
                yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), k).cast(pa.list_(pa.float64()))], names=["row_id", "y"])

    return a.rows.select("row_id", "v").mapInArrow(run, "row_id long, y array<double>")


def omega_frame(spark, columns: int, kp: int, seed: int = SEED) -> DataFrame:
    """(col_id, s, w) of the random matrix."""
    w = omega(columns, kp, seed)
    return spark.createDataFrame([(i, j, float(w[i, j])) for i in range(columns) for j in range(kp)], "col_id int, s int, w double")


def sketch_sparse(coo: DataFrame, columns: int, kp: int, seed: int = SEED) -> DataFrame:
    """(row_id, s, y) from elements (row_id, col_id, val): a join with the random matrix and a sum.

    The random matrix has columns x kp values, whatever the number of rows.
    """
    w = omega_frame(coo.sparkSession, columns, kp, seed)
    return coo.join(w, "col_id").groupBy("row_id", "s").agg(F.sum(F.col("val") * F.col("w")).alias("y"))


@dataclass
class SVD:
    """sigma and V on the driver (k and n x k values); U follows from the QR's blocks when asked for."""

    sigma: np.ndarray
    v_matrix: np.ndarray
    u_hat: np.ndarray
    qr: QR

    def sigma_frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, float(s)) for i, s in enumerate(self.sigma)], "i int, sigma double")

    def u(self, half_sigma: bool = False) -> DataFrame:
        """(row_id, u); with half_sigma U times the root of sigma."""
        right = self.u_hat * np.sqrt(self.sigma) if half_sigma else self.u_hat
        return sketch_dense(Matrix(self.qr.q().withColumnRenamed("q", "v"), self.qr.columns), right).withColumnRenamed("y", "u")

    def v(self, spark, half_sigma: bool = False) -> DataFrame:
        """(col_id, v); with half_sigma V times the root of sigma."""
        m = self.v_matrix * np.sqrt(self.sigma) if half_sigma else self.v_matrix
        return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "col_id int, v array<double>")

    def v_blocks(self, spark, height: int, half_sigma: bool = False) -> DataFrame:
        """V in blocks of so many rows: (block_id, row_start, m, n, data)."""
        m = self.v_matrix * np.sqrt(self.sigma) if half_sigma else self.v_matrix
        rows = [(k // height, k, len(b), m.shape[1], b.ravel().tolist()) for k in range(0, len(m), height) for b in [m[k : k + height]]]
        return spark.createDataFrame(rows, "block_id int, row_start long, m int, n int, data array<double>")


def ssvd(a: Matrix | SparseMatrix, rank: int, oversampling: int = 15, power_iterations: int = 0, schedule: str | list[int] | None = None, split_mb: int = 64, seed: int = SEED) -> SVD:
    """A ~ U S V^T with the rank largest singular values, in descending order.

    The sketch is no wider than the matrix. V's columns have a positive entry of largest size. A singular
    value of 0 (a matrix of lower rank) has zeros for its vectors, not NaN. Each pass reads A once: the
    sketch, its QR and the product with A's rows share it. Sparse rows stay sparse.
    """
    if rank < 1 or rank > a.columns:
        raise ValueError(f"the rank must lie between 1 and {a.columns}")
    m = a.rows.count()
    if m < rank:
        raise ValueError(f"a matrix of {m} rows has no rank {rank}")
    kp = min(rank + oversampling, a.columns, m)
    right = omega(a.columns, kp, seed)
    for _ in range(power_iterations + 1):
        if isinstance(a, SparseMatrix):
            qr = sketched(a, right, schedule, split_mb)
        else:
            qr = tsqr(Matrix(a.rows.select("row_id", "v"), a.columns), schedule, True, split_mb, transform=lambda x, w=right: x @ w, width=kp)
        bt = qr.qt_b_matrix().T  # columns x kp
        right = bt
    values, vectors = symmetric_eigen(bt.T @ bt)
    sigma = np.sqrt(np.maximum(values, 0.0))
    sigma[sigma <= sigma[0] * np.finfo(float).eps * max(bt.shape)] = 0.0
    u_hat, sigma = vectors[:, :rank], sigma[:rank]
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.where(sigma > 0, bt @ u_hat / np.where(sigma > 0, sigma, 1.0), 0.0)
    flip = np.where(v[np.abs(v).argmax(axis=0), np.arange(rank)] < 0, -1.0, 1.0)
    return SVD(sigma, v * flip + 0.0, u_hat * flip * (sigma > 0), qr)
