"""Whole runs from text files to result folders; each stage can be skipped if its folder is there already."""

from __future__ import annotations

import re
import time
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skinnyla.operators.qr import QR, qt_times, tsqr
from skinnyla.operators.ssvd import SVD, ssvd
from skinnyla.plans.planner import check_split
from skinnyla.session import reachable
from skinnyla.sources.matrices import Matrix, from_text, read_blocks, write_blocks

SPLIT, JVM_MB = "spark.sql.files.maxPartitionBytes", re.compile(r"([0-9]+)([mg])")


@contextmanager
def timed(name: str):
    """Prints how many seconds a stage took."""
    began = time.time()
    yield
    print(f"{name} {time.time() - began:.1f} s", flush=True)


def split_for(spark: SparkSession, path: str, split_mb: int) -> int:
    """The split size for the files of a path: larger where one wave of tasks has the memory for it."""
    total = gather(spark, path).agg(F.sum("length")).first()[0] or 0
    slots = spark.sparkContext.defaultParallelism
    memory = JVM_MB.fullmatch(spark.sparkContext.getConf().get("spark.executor.memory", "1g").lower())
    memory_mb = int(memory[1]) * {"m": 1, "g": 1024}[memory[2]] if memory else 1024
    return check_split(split_mb, total, memory_mb, slots)


def ingest(spark: SparkSession, path: str, output: str, sub_rows: int | None = None, split_mb: int = 64, run: bool = True) -> Matrix:
    """The matrix of text files, as blocks under the output; with run=False the blocks of an earlier run."""
    folder = f"{output}/blocks"
    if run:
        kept, size = spark.conf.get(SPLIT), split_for(spark, path, split_mb)
        spark.conf.set(SPLIT, f"{size}m")
        try:
            with timed("ingest"):
                write_blocks(from_text(spark, path).blocks(sub_rows, split_mb), folder)
        finally:
            spark.conf.set(SPLIT, kept)
    return read_blocks(spark, folder)


def save_factors(spark: SparkSession, qr: QR, output: str) -> None:
    qr.blocks.write.mode("overwrite").parquet(f"{output}/factors/blocks")
    qr.chain.write.mode("overwrite").parquet(f"{output}/factors/chain")
    write_matrix(spark, qr.matrix, f"{output}/R")


def load_factors(spark: SparkSession, output: str) -> QR:
    r = read_matrix(spark, f"{output}/R")
    n = r.shape[0]
    blocks, chain = (reachable(spark).read.parquet(f"{output}/factors/{x}") for x in ("blocks", "chain"))
    return QR(r, n, blocks, chain)


def write_matrix(spark: SparkSession, a: np.ndarray, path: str) -> None:
    rows = [(int(i), int(j), float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])]
    spark.createDataFrame(rows, "i int, j int, val double").coalesce(1).write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(path).collect()
    out = np.zeros((1 + max(r.i for r in rows), 1 + max(r.j for r in rows)))
    for r in rows:
        out[r.i, r.j] = r.val
    return out


def run_qr(spark: SparkSession, path: str, output: str, sub_rows: int | None = None, schedule: str = "1", split_mb: int = 64, ingest_stage: bool = True, factor_stage: bool = True, q_stage: bool = True) -> QR:
    """R under output/R and, with q_stage, Q under output/Q as (row_id, q)."""
    a = ingest(spark, path, output, sub_rows, split_mb, ingest_stage)
    if factor_stage:
        with timed("factors"):
            save_factors(spark, tsqr(a, schedule, True, split_mb), output)
    qr = load_factors(spark, output)
    if q_stage:
        with timed("Q"):
            qr.q().write.mode("overwrite").parquet(f"{output}/Q")
    return qr


def run_qtb(spark: SparkSession, path: str, path_b: str, output: str, sub_rows: int | None = None, schedule: str = "1", split_mb: int = 64, output_q: bool = False) -> np.ndarray:
    """Q^T B under output/QtB; with output_q also Q under output/Q."""
    a = ingest(spark, path, output, sub_rows, split_mb)
    with timed("factors"):
        qr = qt_times(a, from_text(spark, path_b), schedule, split_mb)
    with timed("QtB"):
        m = qr.qt_b_matrix()
    write_matrix(spark, m, f"{output}/QtB")
    if output_q:
        qr.q().write.mode("overwrite").parquet(f"{output}/Q")
    return m


def run_ssvd(spark: SparkSession, path: str, output: str, rank: int, oversampling: int = 15, power_iterations: int = 0, sub_rows: int | None = None, schedule: str = "1", split_mb: int = 64, compute_u: bool = True, compute_v: bool = True, u_half_sigma: bool = False, v_half_sigma: bool = False) -> SVD:
    """Sigma, UHat, and U and V if asked for, under the output."""
    a = ingest(spark, path, output, sub_rows, split_mb)
    with timed("sketches"):
        svd = ssvd(a, rank, oversampling, power_iterations, schedule, split_mb)
    svd.sigma_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{output}/Sigma")
    write_matrix(spark, svd.u_hat, f"{output}/UHat")
    if compute_u:
        svd.u(u_half_sigma).write.mode("overwrite").parquet(f"{output}/U")
    if compute_v:
        svd.v(spark, v_half_sigma).coalesce(1).write.mode("overwrite").parquet(f"{output}/V")
    return svd


def gather(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(path, bytes) of the files of a folder whose name starts with the prefix."""
    files = reachable(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.where(files.path.rlike(f"/{prefix}[^/]*$")) if prefix else files
