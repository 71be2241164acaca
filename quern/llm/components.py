"""Connected components by alternating large-star and small-star steps, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: columns a, b of one orderable type. Returns node, component (the smallest node reachable) for every node of an edge.

    Each step hangs the neighbours of a node on its smallest neighbour, so the depth of the trees about halves. A node that a third
    of all edges share is one row on the side of minima, whose partial aggregates are small; the join's other side can be split.
    Edges with a null end are left out; loops, repeated edges and both directions of one are fine. No edges give no rows.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    pairs = materialize(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    nodes = materialize(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), f"{name}-nodes")
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, f"{name}-large")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        others = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialize(others.union(smallest.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), f"{name}-small")
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return nodes.join(pairs, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))
