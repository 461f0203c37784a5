"""Times the QR and SVD of four lineitem measures beside numpy on the driver and Spark's own row matrices.

Usage: python compare.py [folder]. A warm-up run, then the median of five.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main(folder: str) -> None:
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from skinnyla.operators.qr import qt_times, tsqr
    from skinnyla.operators.ssvd import ssvd
    from skinnyla.session import cut, table
    from skinnyla.sources import matrices as mx

    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    lines = table(spark, folder, "lineitem")
    a = mx.from_table(lines, columns, F.monotonically_increasing_id())
    a = mx.Matrix(cut(a.rows), 4)
    noop = lambda df: df.write.format("noop").mode("overwrite").save()

    def pulled() -> np.ndarray:
        return lines.select(*columns).toPandas().to_numpy()

    def rows() -> RowMatrix:
        return RowMatrix(a.rows.select("v").rdd.map(lambda r: Vectors.dense(r.v)))

    jobs = {
        "R": lambda: tsqr(a).matrix,
        "Q and R": lambda: noop(tsqr(a, keep_q=True).q()),
        "Q^T B": lambda: qt_times(a, a).qt_b_matrix(),
        "SSVD, q=0": lambda: ssvd(a, 2, 2, 0).sigma,
        "SSVD, q=1": lambda: ssvd(a, 2, 2, 1).sigma,
        "numpy on the driver, Q and R": lambda: np.linalg.qr(pulled()),
        "numpy on the driver, SVD": lambda: np.linalg.svd(pulled(), full_matrices=False),
        "RowMatrix.tallSkinnyQR, R": lambda: rows().tallSkinnyQR(False),
        "RowMatrix.computeSVD": lambda: rows().computeSVD(2, False),
    }
    out = {}
    for name, job in jobs.items():
        took = []
        for _ in range(6):
            began = time.time()
            job()
            took.append(time.time() - began)
        out[name] = round(median(took[1:]), 2)
        print(name, out[name], file=sys.stderr, flush=True)
    print(json.dumps(out))


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
