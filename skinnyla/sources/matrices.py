"""Matrices as DataFrames: text and tables in, blocks and text out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skinnyla.functions.hashing import SEED, omega
from skinnyla.functions.scalar import block_of, parse_row
from skinnyla.plans.planner import check_sub_rows
from skinnyla.session import cut, reachable


@dataclass
class Matrix:
    """rows: (row_id long, v array<double>), one row for each row of the matrix; columns: how many it has."""

    rows: DataFrame
    columns: int

    def coo(self) -> DataFrame:
        """(row_id, col_id, val) of all elements that are not 0."""
        return self.rows.select("row_id", F.posexplode("v").alias("col_id", "val")).where("val <> 0")

    def blocks(self, sub_rows: int | None = None, split_mb: int = 64, count: int | None = None) -> DataFrame:
        """(block_id, row_start, m, n, data): rows stacked in the order of row_id, which counts from 0."""
        count = self.rows.count() if count is None else count
        s = check_sub_rows(sub_rows, self.columns, split_mb)
        with_id = self.rows.withColumn("block_id", block_of(F.col("row_id"), count, s))
        stacked = with_id.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("row_id", "v"))).alias("own"))
        return stacked.select("block_id", F.col("own")[0]["row_id"].alias("row_start"), F.size("own").alias("m"), F.lit(self.columns).alias("n"), F.flatten(F.transform("own", lambda x: x["v"])).alias("data"))


def read_lines(spark: SparkSession, paths: str | Sequence[str], prefix: str = "") -> DataFrame:
    """(value, file, split) of the lines of all files whose name starts with the prefix."""
    lines = reachable(spark).read.text(paths if isinstance(paths, str) else list(paths))
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_name").alias("name"))
    return (lines.where(F.col("name").startswith(prefix)) if prefix else lines).drop("name")


def rows_per_split(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file", "split").agg(F.count("*").alias("n"))


def prefix_rows(counts: DataFrame) -> DataFrame:
    """(file, split, n, before): how many rows lie in earlier splits. The window is over splits, not rows."""
    w = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def infer_columns(lines: DataFrame) -> int:
    """Numbers on a line. All lines must have as many, so the first that a task reads will do."""
    first = lines.select(F.size(F.split(F.rtrim("value"), " ")).alias("n")).first()
    if first is None:
        raise ValueError("the input has no line")
    return first.n


def checked(line: Column, columns: int) -> Column:
    """The line's numbers; a task fails where their count differs or one is no number."""
    parts = F.split(F.rtrim(line), " ")
    wrong = F.raise_error(F.concat(F.lit(f"a line has not {columns} numbers: "), F.substring(line, 1, 80)))
    return F.when(F.size(parts) == columns, parse_row(line)).otherwise(wrong.cast("array<double>"))


def numbered(lines: DataFrame) -> DataFrame:
    """(row_id, value): lines counted from 0 in the order of file, split and place.

    Places are counted within a split and splits are summed, so that no window holds all rows.
    """
    placed = lines.withColumn("at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("file", "split").orderBy("at"))
    before = prefix_rows(rows_per_split(lines)).select("file", "split", "before")
    return placed.withColumn("place", place).join(before, ["file", "split"]).select((F.col("before") + F.col("place") - 1).alias("row_id"), "value")


def from_text(spark: SparkSession, paths: str | Sequence[str], prefix: str = "") -> Matrix:
    """A matrix of one row for each line, numbers separated by a space."""
    lines = read_lines(spark, paths, prefix)
    n = infer_columns(lines)
    return Matrix(numbered(lines).select("row_id", checked(F.col("value"), n).alias("v")), n)


def from_table(df: DataFrame, columns: Sequence[str | Column], row_id: str | Column) -> Matrix:
    """A matrix of numeric columns; only these and the row's id (a unique long) are read."""
    values = F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns])
    return Matrix(df.select((F.col(row_id) if isinstance(row_id, str) else row_id).cast("long").alias("row_id"), values.alias("v")), len(columns))


def from_sorted_table(df: DataFrame, columns: Sequence[str | Column], keys: Sequence[str]) -> Matrix:
    """A matrix whose rows count from 0 in the order of the keys, without a window over all rows."""
    values = F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns])
    dealt = df.select(*keys, values.alias("v")).repartitionByRange(*keys).withColumn("part", F.spark_partition_id())
    dealt = cut(dealt)  # the parts must not change between the two passes
    before = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*keys))
    rows = dealt.withColumn("place", place).join(before, "part").select((F.col("before") + F.col("place") - 1).alias("row_id"), "v")
    return Matrix(rows, len(columns))


def from_array(df: DataFrame, vector: str, row_id: str) -> Matrix:
    """A matrix of an array column; its width is that of the first row."""
    n = df.select(F.size(vector).alias("n")).first().n
    fine = F.when(F.size(vector) == n, F.col(vector).cast("array<double>")).otherwise(F.raise_error(F.lit("rows differ in width")).cast("array<double>"))
    return Matrix(df.select(F.col(row_id).cast("long").alias("row_id"), fine.alias("v")), n)


def from_coo(df: DataFrame, columns: int) -> Matrix:
    """A matrix of (row_id, col_id, val), elements of the same place summed; rows without elements are absent."""
    own = df.groupBy("row_id", "col_id").agg(F.sum("val").alias("val")).groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("col_id", "val"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0)))
    return Matrix(own.select(F.col("row_id").cast("long").alias("row_id"), dense.alias("v")), columns)


def write_text(matrix: Matrix, path: str) -> None:
    matrix.rows.orderBy("row_id").select(F.array_join(F.transform("v", lambda x: x.cast("string")), " ").alias("value")).write.mode("overwrite").text(path)


def write_blocks(blocks: DataFrame, path: str) -> None:
    blocks.write.mode("overwrite").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> Matrix:
    """The matrix of a folder of blocks."""
    b = reachable(spark).read.parquet(path)
    n = b.select("n").first().n
    rows = b.select("row_start", "n", "data", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"))
    return Matrix(rows.select((F.col("row_start") + F.col("i")).alias("row_id"), F.slice("data", F.col("i") * F.col("n") + 1, F.col("n")).alias("v")), n)


def random_upper(spark: SparkSession, size: int, number: int, seed: int = SEED) -> DataFrame:
    """number blocks (key, m, n, data), each the same random upper-triangular matrix of values in [0, 1)."""
    data = F.array(*[F.lit(float(x)) for x in np.triu(omega(size, size, seed) + 0.5).ravel()])
    return spark.range(number).select(F.col("id").cast("int").alias("key"), F.lit(size).alias("m"), F.lit(size).alias("n"), data.alias("data"))
