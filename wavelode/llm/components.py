"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of links (a, b), all longs.

    Loops and repeated links are allowed; an empty table gives an empty result. Each round hangs
    every node under a smaller one of its component and ends when nothing moves (about log n
    rounds). Minima are pre-aggregated; the joins are plain ones, which adaptive execution splits at
    a node with very many links. Each round is a written table, so lineage stays short.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges, seen = stored(edges, "links"), None
    while True:
        lower = edges.groupBy(F.col("hi").alias("key")).agg(F.min("lo").alias("top"))
        # Large star: what lies above a node goes to that node's smallest neighbour.
        raised = edges.join(lower, F.col("lo") == F.col("key"), "left").select("hi", F.coalesce("top", "lo").alias("lo")).distinct()
        # Small star: a node and all that lie below it go to the smallest of these.
        least = raised.groupBy(F.col("hi").alias("key")).agg(F.min("lo").alias("top"))
        below = raised.join(least, F.col("hi") == F.col("key")).where("lo <> top").select(F.col("lo").alias("hi"), F.col("top").alias("lo"))
        edges = stored(below.unionByName(least.select(F.col("key").alias("hi"), F.col("top").alias("lo"))).distinct(), "links")
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if mark == seen:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
                edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
            )
        seen = mark
