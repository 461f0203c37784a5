"""Session helpers: reaching the package from workers, and the folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers that start on this machine import the package from where the driver has it.

    On a cluster the package is shipped with --py-files or installed on the nodes.
    """
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, have]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A temporary folder stands in only in local mode."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if own:
        return own
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="skinnyla-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_path(spark: SparkSession, name: str = "skinnyla") -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{folder}/{name}.parquet")
