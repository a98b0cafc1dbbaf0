"""Connected components of a link table by alternating star contractions.

Each round is two grouped minima and joins over the remaining links; no node's neighbours are collected. Minima are
combined on the map side. Before a join, both sides are tables of the shared folder, so that Spark's adaptive plan sees
plain shuffles and splits the partition of a hub (a node with a large part of all links) over tasks. Joins are merge joins,
so nothing is gathered on the driver. A round's tables are deleted once the next round is written. The number of rounds
grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerostrata.llm.common import Stored


def _mark(edges: DataFrame) -> tuple:
    """Size and content hash of a link table."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    Links of a node to itself, repeated links and links with a null end count for nothing. No link gives an empty table.
    """
    edges = Stored(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _mark(edges.df)
    while before[0]:
        # large star: neighbours above a node move to the smallest node around it
        both = edges.df.union(edges.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = Stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = Stored(both.where("b > a").join(least.df.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # small star: a node and the neighbours below it move to the smallest of these
        low = Stored(large.df.groupBy("a").agg(F.min("b").alias("m")))
        moved = large.df.join(low.df.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = Stored(moved.union(low.df.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        for done in (edges, least, large, low):
            done.drop()
        edges = small
        after = _mark(edges.df)
        if after == before:
            break
        before = after
    tops = edges.df.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.df.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
