"""python -m skinnyla qr | qtb | ssvd | dump | genr"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from skinnyla.operators.diagnostics import dump
from skinnyla.plans import runner
from skinnyla.session import reachable
from skinnyla.sources.matrices import random_upper


def truth(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError("true or false")
    return text.lower() == "true"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skinnyla", description="Tall-and-skinny QR and stochastic SVD on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-input", "--input", required=True, help="text files, a row on each line, numbers separated by a space")
    common.add_argument("-output", "--output", required=True)
    common.add_argument("-subRowSize", "--sub-rows", type=int, help="rows of a block; the number of columns if not given")
    common.add_argument("-reduceSchedule", "--schedule", default="1", help="groups of each tree level, the last 1: 4,1")
    common.add_argument("-mis", "--split-mb", type=int, default=64)
    common.add_argument("-job1ReduceTasks", help="accepted, has no effect")
    qr = sub.add_parser("qr", parents=[common], help="R and Q")
    for flag, name in (("-job1", "--ingest"), ("-job2", "--factor"), ("-job3", "--build-q")):
        qr.add_argument(flag, name, type=truth, default=True)
    qtb = sub.add_parser("qtb", parents=[common], help="the transposed Q times a second matrix")
    qtb.add_argument("-inputB", "--input-b", required=True)
    qtb.add_argument("-outputQ", "--output-q", type=truth, default=False)
    svd = sub.add_parser("ssvd", parents=[common], help="stochastic SVD")
    svd.add_argument("-rank", "--rank", type=int, required=True)
    svd.add_argument("-oversampling", "--oversampling", type=int, default=15)
    svd.add_argument("-powerIter", "--power-iterations", type=int, default=0)
    for flag, name, default in (("-computeU", "--compute-u", True), ("-computeV", "--compute-v", True), ("-uHalfSigma", "--u-half-sigma", False), ("-vHalfSigma", "--v-half-sigma", False)):
        svd.add_argument(flag, name, type=truth, default=default)
    for flag in ("-reduceTasks", "-outerProdBlockHeight", "-blockHeight", "-abtBlockHeight", "-minSplitSize", "-broadcast"):
        svd.add_argument(flag, help="accepted, has no effect")
    show = sub.add_parser("dump", help="print a folder of blocks")
    show.add_argument("-input", "--input", required=True)
    gen = sub.add_parser("genr", help="write a random upper-triangular matrix many times")
    gen.add_argument("-size", "--size", type=int, required=True)
    gen.add_argument("-number", "--number", type=int, required=True)
    gen.add_argument("-output", "--output", required=True)
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = reachable(SparkSession.builder.getOrCreate())
    began = time.time()
    if a.command == "qr":
        runner.run_qr(spark, a.input, a.output, a.sub_rows, a.schedule, a.split_mb, a.ingest, a.factor, a.build_q)
    elif a.command == "qtb":
        runner.run_qtb(spark, a.input, a.input_b, a.output, a.sub_rows, a.schedule, a.split_mb, a.output_q)
    elif a.command == "ssvd":
        runner.run_ssvd(spark, a.input, a.output, a.rank, a.oversampling, a.power_iterations, a.sub_rows, a.schedule, a.split_mb, a.compute_u, a.compute_v, a.u_half_sigma, a.v_half_sigma)
    elif a.command == "dump":
        for row in dump(spark.read.parquet(a.input), spark.read.parquet(a.input).columns[0]).toLocalIterator():
            print(row.text)
    else:
        random_upper(spark, a.size, a.number).write.mode("overwrite").parquet(a.output)
    print(f"total {time.time() - began:.1f} s")
    return 0
