"""Connected components by alternating large and small stars, without a vertex's neighbours in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import written


#: Edges that a task writes, at most, on average.
EDGES_PER_FILE = 200_000


def _least(edges: DataFrame) -> DataFrame:
    """u and m, the least of u and its neighbours v."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    to = edges.join(low, "u")
    return to.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """v and root, the least vertex of its component, of every vertex in an edge (columns u and v, any direction).

    Each round is written to the shared folder, so that lineage stays short and a
    lost executor costs the tasks of one round. Few edges are written by few tasks, so that
    rounds don't end in many small files.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    few = now.count() // EDGES_PER_FILE + 1
    while True:
        now = written(_small_star(_large_star(now)).coalesce(few))
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(now.select("v", F.col("v").alias("root")).distinct())
        mark = found
