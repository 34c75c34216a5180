"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node it reaches) of every node of an edge.

    Alternates large-star and small-star steps, which take a number of rounds
    that grows with the logarithm of the component, not with its diameter.
    Neighbourhoods are never collected: their minima are aggregated before they
    are shuffled and joined back, which can be split where a node is hot. Each
    round is written to the checkpoint folder. Null ends are dropped.
    """
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").distinct())
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    e = e.where("u != v")
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # large star: the larger neighbours go to the least of the neighbourhood
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # small star: each node and its smaller neighbours go to the least of these
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        e = cut(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
