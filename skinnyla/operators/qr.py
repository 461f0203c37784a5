"""Thin QR of tall-and-skinny matrices by a reduction tree, and products with the transposed Q.

Level 1 factors chunks of rows where they lie, without a shuffle, and writes their Q blocks beside their R.
Groups are named by the task that made them, which is safe only because the result is written once and
read from there. The tree stacks R factors, a group of them in a task, and keeps each child's slice of Q. The
slices on a group's way to the root are folded into one small matrix, so that Q costs one product a block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skinnyla.functions.kernels import canonical, thin_qr
from skinnyla.plans.planner import group_rows, parse_schedule, schedule_for
from skinnyla.session import cut
from skinnyla.sources.matrices import Matrix

LEVEL1 = "group_id long, row_ids array<long>, q array<double>, b array<double>, r array<double>, rows long"
#: Rows of a written Q block: small enough to be one row of a table, large enough for a matrix product.
BLOCK_ROWS = 2048


def stack(column: pa.Array, n: int) -> np.ndarray:
    """The rows of an array column as a matrix; a null or a row of another width is an error."""
    flat = column.flatten()
    if column.null_count or flat.null_count or len(flat) != len(column) * n:
        raise ValueError(f"a row does not hold {n} numbers")
    return flat.to_numpy(zero_copy_only=False).reshape(-1, n)


def flat(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).ravel()


def lists(parts: list[np.ndarray | None], kind: pa.DataType = pa.float64()) -> pa.Array:
    return pa.array(parts, pa.list_(kind))


NAMES = ["group_id", "row_ids", "q", "b", "r", "rows"]
NO_ROWS = pa.nulls(1, pa.int64())


def factor_row(group: int, r: np.ndarray, count: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([group]), lists([None], pa.int64()), lists([None]), lists([None]), lists([flat(r)]), pa.array([count])], names=NAMES)


def level1(rows: DataFrame, n: int, nb: int, keep_q: bool, chunk: int, transform=None) -> DataFrame:
    """Local factors of rows(row_id, v[, b]).

    A chunk's R is a row of its own, beside the number of its rows; with keep_q its Q comes in blocks, each with its
    rows' ids and b.
    transform maps v before it is factored; b is v then.
    """

    def factor(group: int, ids: np.ndarray, a: np.ndarray, b: np.ndarray | None, count: int):
        q, r = thin_qr(a)
        yield factor_row(group, r, count)
        for s in range(0, len(ids) if keep_q else 0, BLOCK_ROWS):
            e = s + BLOCK_ROWS
            yield pa.RecordBatch.from_arrays([pa.array([group]), lists([ids[s:e]], pa.int64()), lists([flat(q[s:e])]), lists([flat(b[s:e]) if b is not None else None]), lists([None]), NO_ROWS], names=NAMES)

    def run(batches):
        base, made, ids, mats, extra, held = TaskContext.get().partitionId() << 32, 0, [], [], [], 0
        running, count = np.zeros((0, n)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = stack(batch.column(1), nb if transform else n)
            a = transform(v) if transform else v
            if not keep_q:  # R alone needs no more than a batch in memory
                running = thin_qr(np.vstack([running, a]))[1]
                count += len(a)
                continue
            ids.append(batch.column(0).to_numpy())
            mats.append(a)
            extra.append(v if transform else stack(batch.column(2), nb) if nb else None)
            held += len(a)
            if held >= chunk:
                yield from factor(base + made, np.concatenate(ids), np.vstack(mats), np.vstack(extra) if nb else None, held)
                made, ids, mats, extra, held = made + 1, [], [], [], 0
        if held:
            yield from factor(base + made, np.concatenate(ids), np.vstack(mats), np.vstack(extra) if nb else None, held)
        if len(running):
            yield factor_row(base, thin_qr(running)[1], count)

    return rows.mapInArrow(run, LEVEL1)


def merge(factors: DataFrame, n: int, groups: int) -> DataFrame:
    """One tree level: (parent, child, f, r); f is a child's slice of Q, r stands beside the first child."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group_id", ignore_index=True)
        q, r = thin_qr(np.vstack([np.asarray(x).reshape(n, n) for x in pdf["r"]]))
        slices = [flat(q[i * n : (i + 1) * n]) for i in range(len(pdf))]
        return pd.DataFrame({"parent": pdf["parent"], "child": pdf["group_id"], "f": slices, "r": [flat(r)] + [None] * (len(pdf) - 1)})

    keyed = factors.withColumn("parent", F.pmod(F.xxhash64("group_id"), F.lit(groups)))
    return keyed.groupBy("parent").applyInPandas(run, "parent long, child long, f array<double>, r array<double>")


@dataclass
class QR:
    """R on the driver; blocks and chain hold Q until it is asked for."""

    matrix: np.ndarray
    columns: int
    blocks: DataFrame | None
    chain: DataFrame | None
    b_columns: int = 0

    def r(self, spark) -> DataFrame:
        """(i, j, val) of R's upper triangle."""
        n = self.columns
        return spark.createDataFrame([(i, j, float(self.matrix[i, j])) for i in range(n) for j in range(i, n)], "i int, j int, val double")

    def _joined(self) -> DataFrame:
        return self.blocks.join(self.chain, "group_id").select("row_ids", "q", "b", "c")

    def q(self) -> DataFrame:
        """(row_id, q): the rows of Q."""
        n = self.columns

        def run(batches):
            for batch in batches:
                for ids, q, c in zip(batch.column(0), batch.column(1), batch.column(3), strict=True):
                    out = q.values.to_numpy().reshape(-1, n) @ c.values.to_numpy().reshape(n, n)
                    yield pa.RecordBatch.from_arrays([ids.values, pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), n).cast(pa.list_(pa.float64()))], names=["row_id", "q"])

        return self._joined().mapInArrow(run, "row_id long, q array<double>")

    def qt_b_matrix(self) -> np.ndarray:
        """Q^T B for the b that was carried along: a sum of block products, each task's summed in it."""
        n, nb = self.columns, self.b_columns

        def run(batches):
            total = np.zeros((n, nb))
            for batch in batches:
                for q, b, c in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                    total += c.values.to_numpy().reshape(n, n).T @ (q.values.to_numpy().reshape(-1, n).T @ b.values.to_numpy().reshape(-1, nb))
            at = np.arange(n * nb)
            yield pa.RecordBatch.from_arrays([pa.array((at // nb).astype(np.int32)), pa.array((at % nb).astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "val"])

        out = np.zeros((n, nb))
        for x in self._joined().mapInArrow(run, "i int, j int, val double").groupBy("i", "j").agg(F.sum("val").alias("val")).collect():
            out[x.i, x.j] = x.val
        return out

    def qt_b(self, spark) -> DataFrame:
        """(i, j, val) of Q^T B."""
        m = self.qt_b_matrix()
        return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i int, j int, val double")


def tsqr(a: Matrix, schedule: str | list[int] | None = None, keep_q: bool = False, split_mb: int = 64, payload: int = 0, transform=None, width: int | None = None) -> QR:
    """A = QR with a diagonal of R that is not negative (Q's columns flipped alike).

    schedule: groups of each tree level, as "4,1"; left out, no task stacks more than a split of factors.
    payload: columns of b that a.rows carries for products with Q^T. transform with width: A is
    transform(v), of so many columns, and b is v. Fewer rows than columns are an error.
    """
    n = width if transform else a.columns
    payload = a.columns if transform else payload
    chunk = group_rows(n, payload, split_mb)
    written = cut(level1(a.rows, n, payload, keep_q, chunk, transform))
    r, chain = factor_tree(written, n, schedule, keep_q, split_mb)
    return QR(r, n, written.where("q is not null").select("group_id", "row_ids", "q", "b"), chain, payload) if keep_q else QR(r, n, None, None)


def factor_tree(written: DataFrame, n: int, schedule: str | list[int] | None, keep_q: bool, split_mb: int) -> tuple[np.ndarray, DataFrame | None]:
    """(R, chain) of level 1's rows: the tree over their factors, and with keep_q its slices folded for each chunk."""
    spark = written.sparkSession
    own = written.where("r is not null").select("group_id", "r")
    count, rows = written.where("r is not null").agg(F.count("*"), F.sum("rows")).first()
    if not count:
        raise ValueError("the matrix has no rows")
    if rows < n:
        raise ValueError(f"a tall matrix is needed; this has {rows} rows and {n} columns")
    levels = parse_schedule(schedule) or schedule_for(count, n, split_mb)
    merged = []
    for groups in levels:
        level = cut(merge(own, n, groups))
        merged.append(level)
        own = level.where("r is not null").select(F.col("parent").alias("group_id"), "r")
    root = np.asarray(own.first().r).reshape(n, n)
    d, r = canonical(root)
    if not keep_q:
        return r, None
    chain = spark.createDataFrame([(0, flat(np.diag(d)).tolist())], "parent long, c array<double>")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [flat(np.asarray(f).reshape(n, n) @ np.asarray(c).reshape(n, n)) for f, c in zip(pdf["f"], pdf["c"], strict=True)]
        return pd.DataFrame({"parent": pdf["child"], "c": out})

    for level in reversed(merged):
        joined = level.select("parent", "child", "f").join(chain, "parent").select("child", "f", "c")
        chain = joined.mapInPandas(lambda frames: map(fold, frames), "parent long, c array<double>")
    return r, cut(chain.select(F.col("parent").alias("group_id"), "c"))


def check_ids(a: Matrix, b: Matrix) -> None:
    """An error unless a and b have the same row ids, each once. Only ids and counts are shuffled."""
    ids = [m.rows.select("row_id", F.lit(i).alias("a"), F.lit(1 - i).alias("b")) for i, m in ((1, a), (0, b))]
    odd = ids[0].unionByName(ids[1]).groupBy("row_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("row_id is null or a <> 1 or b <> 1").first()
    if odd is not None:
        raise ValueError(f"A has {odd.a} rows and B {odd.b} with the id {odd.row_id}; both need the same ids, each once")


def qt_times(a: Matrix, b: Matrix, schedule: str | list[int] | None = None, split_mb: int = 64) -> QR:
    """The QR of a with b carried along, for Q^T B. Both need the same rows, by id, and each id once."""
    check_ids(a, b)
    both = a.rows.join(b.rows.select("row_id", F.col("v").alias("b")), "row_id").select("row_id", "v", "b")
    return tsqr(Matrix(both, a.columns), schedule, True, split_mb, b.columns)


def reduce_tree(factors: DataFrame, n: int, schedule: str | list[int]) -> np.ndarray:
    """R of a tree over given R factors (group_id, r) alone."""
    for groups in parse_schedule(schedule):
        factors = cut(merge(factors, n, groups)).where("r is not null").select(F.col("parent").alias("group_id"), "r")
    return canonical(np.asarray(factors.first().r).reshape(n, n))[1]
