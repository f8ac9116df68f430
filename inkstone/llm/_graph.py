"""Connected components of an undirected graph, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialise


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each u has one v and no v is a u: then each component is one star around its smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("hub")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("hub")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("hub").alias("hub")).where("out > 1 or (out > 0 and hub > 0)").isEmpty()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): each node that has an edge, and the smallest node that it can reach.

    Alternating large-star and small-star steps: a node hands its larger neighbours, then itself and its smaller
    ones, to the least of them, until each component is a star. A step is a partial aggregate (the least neighbour) and an
    equi-join; it never gathers the neighbours of a node, so a hub with a third of all edges is split like any skewed
    join side. Every step is written to the shared folder. Self-loops and null ends are ignored; no edges give no rows.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "graph")
    while not _is_star_forest(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        kept = low.select("u", F.col("m").alias("v"))
        handed = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(kept.unionByName(handed).distinct(), "graph")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
