"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is an aggregation and a join on the edge table, stored in the shared folder; nothing is collected but one
checksum for each round. Stars keep the number of edges from growing, and the rounds grow with the logarithm of the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.llm._common import new_path, remove, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node joins its larger neighbours to the smallest node it knows."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node joins its smaller neighbours and itself to the smallest of them. edges: u < v."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.union(least.select(F.col("m").alias("u"), "v"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for each node of an edge; edges: u, v of one ordered type, u <> v."""
    spark, path = edges.sparkSession, new_path(edges.sparkSession, "edges")
    edges = stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges", path)
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while before[0]:
        old, path = path, new_path(spark, "edges")
        edges = stored(_small_star(_large_star(edges).where("u < v").distinct()).where("u < v").distinct(), "edges", path)
        remove(spark, old)
        if (after := mark(edges)) == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots)
