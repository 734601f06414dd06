"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def _mark(edges: DataFrame):
    """The number of edges and a sum over them, to tell whether anything changed."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(node, root) for every node in a link (columns u, v) whose root, the smallest node it reaches, is another.

    Links go in either direction and may repeat; loops are ignored. No node's
    neighbours are ever gathered: only their minimum is, combined on the map
    side. The number of rounds grows with the logarithm of the nodes.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = stage(edges, "links")
    before = _mark(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        # large star: larger neighbours of a node join its smallest one
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large")
        # small star: a node and its smaller neighbours join the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not done after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
