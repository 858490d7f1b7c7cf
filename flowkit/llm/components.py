"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Most edges of which the least neighbours are broadcast: some 16 MB.
FEW_EDGES = 250_000


def _state(edges: DataFrame) -> tuple:
    """Count and checksum of an edge set."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> (node, component): the smallest node reachable.

    Only nodes of some edge appear. Loops, repeated edges and nulls (dropped)
    are allowed; without edges the result is empty. Each step is two
    aggregations and a join over the edges, written to the shared folder; a
    node of any degree is handled by min(), never by a list of its neighbours.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and a <> b").distinct()
    edges = written(edges, "edges")
    before = _state(edges)
    while before[0]:
        # least neighbours are no more than twice the edges: broadcast while those are few
        hinted = F.broadcast if before[0] <= FEW_EDGES else lambda df: df
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(hinted(least), "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(hinted(down), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down)
        old, edges = edges, written(small.filter("a <> b").distinct(), "edges")
        discard(old)
        after = _state(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
