"""Connected components of an edge table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (a, b) reaches.

    Alternating large-star and small-star steps: every round is two aggregations of the edge table by node, keeps
    the components, and about halves the distance to the smallest node. Neighbour lists are never collected: a star
    step needs only the minimum of a node's neighbours, joined back to the edges.
    Self-links are allowed; null ends are left out. An empty edge table gives an empty result.
    """
    edges = written(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a < b").distinct()
    )
    last = None
    for _ in range(most_rounds):
        # large star: each node's larger neighbours go to its smallest neighbour or itself
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        # small star: each node's smaller neighbours and itself go to the smallest of them
        down = large.where("a < b").distinct()
        smallest = down.groupBy("b").agg(F.min("a").alias("m"))
        small = down.join(smallest, "b").select("m", F.explode(F.array("a", "b")).alias("b")).where("m < b")
        last_edges, edges = edges, written(small.select(F.col("m").alias("a"), "b").distinct())
        delete(last_edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
