"""Sparse rows through the stochastic SVD: sketch, QR and products without a dense row of A."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skinnyla.functions.kernels import thin_qr
from skinnyla.operators.qr import BLOCK_ROWS, LEVEL1, NAMES, QR, factor_row, factor_tree, flat, lists
from skinnyla.plans.planner import group_rows
from skinnyla.session import cut

SPARSE = f"{LEVEL1}, cols array<int>, vals array<double>, sizes array<int>"
SPARSE_NAMES = [*NAMES, "cols", "vals", "sizes"]


@dataclass
class SparseMatrix:
    """rows: (row_id long, cols array<int>, vals array<double>), the elements of a row that are not 0; columns: how many there are."""

    rows: DataFrame
    columns: int


def from_elements(df: DataFrame, columns: int) -> SparseMatrix:
    """The matrix of (row_id, col_id, val), elements of the same place summed; rows without elements are absent."""
    fine = F.when(F.col("col_id").between(0, columns - 1), F.col("col_id").cast("int")).otherwise(F.raise_error(F.lit(f"a column is not below {columns}")).cast("int"))
    one = df.groupBy("row_id", fine.alias("col_id")).agg(F.sum("val").cast("double").alias("val")).where("val <> 0")
    rows = one.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("col_id", "val"))).alias("e"))
    return SparseMatrix(rows.select(F.col("row_id").cast("long").alias("row_id"), F.col("e.col_id").alias("cols"), F.col("e.val").alias("vals")), columns)


def times(sizes: np.ndarray, cols: np.ndarray, vals: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sparse rows, one after another, times a dense matrix."""
    out = np.zeros((len(sizes), right.shape[1]))
    some = np.flatnonzero(sizes)
    if len(some):
        starts = np.cumsum(sizes) - sizes
        out[some] = np.add.reduceat(vals[:, None] * right[cols], starts[some])
    return out


class SparseQR(QR):
    """QR of a sketch, whose blocks carry the sparse rows that they come from."""

    def qt_b_matrix(self) -> np.ndarray:
        """Q^T A: each task adds its rows' elements, times their rows of Q, to one matrix of Q's width by A's columns."""
        n, columns = self.columns, self.b_columns

        def run(batches):
            total = np.zeros((columns, n))
            for batch in batches:
                for q, c, cols, vals, sizes in zip(*batch.columns, strict=True):
                    own = q.values.to_numpy().reshape(-1, n) @ c.values.to_numpy().reshape(n, n)
                    row = np.repeat(np.arange(len(own)), sizes.values.to_numpy())
                    np.add.at(total, cols.values.to_numpy(), vals.values.to_numpy()[:, None] * own[row])
            at = np.arange(total.size)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["at", "val"])

        out = np.zeros(columns * n)
        joined = self.blocks.join(self.chain, "group_id").select("q", "c", "cols", "vals", "sizes")
        for x in joined.mapInArrow(run, "at long, val double").groupBy("at").agg(F.sum("val").alias("val")).collect():
            out[x["at"]] = x.val
        return out.reshape(columns, n).T


def sketched(a: SparseMatrix, right: np.ndarray, schedule: str | list[int] | None = None, split_mb: int = 64) -> SparseQR:
    """The QR of A right, with A's rows carried along as they are."""
    n = right.shape[1]
    chunk = group_rows(n, 0, split_mb)

    def factor(group: int, ids, sizes, cols, vals, y):
        q, r = thin_qr(y)
        yield pa.RecordBatch.from_arrays([*factor_row(group, r, len(ids)).columns, lists([None], pa.int32()), lists([None]), lists([None], pa.int32())], names=SPARSE_NAMES)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for s in range(0, len(ids), BLOCK_ROWS):
            e = min(len(ids), s + BLOCK_ROWS)
            own = slice(ends[s], ends[e])
            yield pa.RecordBatch.from_arrays(
                [pa.array([group]), lists([ids[s:e]], pa.int64()), lists([flat(q[s:e])]), lists([None]), lists([None]), pa.nulls(1, pa.int64()), lists([cols[own]], pa.int32()), lists([vals[own]]), lists([sizes[s:e]], pa.int32())],
                names=SPARSE_NAMES,
            )

    def run(batches):
        base, made, held = TaskContext.get().partitionId() << 32, 0, []
        for b in batches:
            if not b.num_rows:
                continue
            sizes = np.asarray(b.column(1).value_lengths()).astype(np.int32)
            cols, vals = b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy(zero_copy_only=False)
            held.append((b.column(0).to_numpy(), sizes, cols, vals, times(sizes, cols, vals, right)))
            if sum(len(x[0]) for x in held) >= chunk:
                yield from factor(base + made, *map(np.concatenate, zip(*held, strict=True)))
                made, held = made + 1, []
        if held:
            yield from factor(base + made, *map(np.concatenate, zip(*held, strict=True)))

    written = cut(a.rows.select("row_id", "cols", "vals").mapInArrow(run, SPARSE))
    r, chain = factor_tree(written, n, schedule, True, split_mb)
    return SparseQR(r, n, written.where("q is not null").select("group_id", "row_ids", "q", "b", "cols", "vals", "sizes"), chain, a.columns)
