"""Connected components of a large graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skinnyla.llm.common import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node of an edge between two nodes, and the smallest node of its component.

    Each step keeps or shrinks the number of edges and needs about log n rounds. Minima are summed by
    partial aggregates and written before they are joined, so that a node with very many edges is joined
    by a hash table or by Spark's splitting of skewed partitions. No edge reaches the driver.
    """
    e = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct())
    before = None
    while True:
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = cut(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")))
        large = cut(both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct())
        least = cut(large.groupBy("x").agg(F.min("y").alias("m")))
        small = large.join(least, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        e = cut(small.unionByName(least.select("x", F.col("m").alias("y"))).distinct())
    roots = e.select("y").distinct().select(F.col("y").alias("node"), F.col("y").alias("label"))
    return cut(e.select(F.col("x").alias("node"), F.col("y").alias("label")).unionByName(roots))
