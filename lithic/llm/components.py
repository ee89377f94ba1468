"""Connected components with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node that can be reached) of every node of ``edges`` (a, b).

    Alternates large-star and small-star steps, which halve paths while they
    never add edges, until nothing changes.  Both steps link each node to the
    least of its neighbours: an aggregate with map-side combining and a join
    whose skewed keys the adaptive planner can split; no node's neighbours are
    ever gathered in one place.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        # Large star: every greater neighbour of a node moves to the least node of its neighbourhood.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every smaller neighbour of a node, and the node, move to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        before, now = now, materialize(small.where("u <> v").distinct(), "stars")
        discard(before)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark is not None and tuple(new) == mark:
            break
        mark = tuple(new)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
