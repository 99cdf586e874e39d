"""Connected components of an edge table, without collecting it anywhere.

Alternating large-star and small-star steps (Kiveris and others, "Connected components in MapReduce and beyond",
2014). Each step is one aggregation, which combines before the shuffle, and one equi-join, whose hot partitions
adaptive execution can split; each round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node gets an edge to the least node of the neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return (
        both.filter("b > a").join(least, F.col("a") == F.col("n")).filter("b <> m")
        .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours get an edge to the least of them; edges point from large to small."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    joined = edges.join(least, F.col("a") == F.col("n"))
    return (
        joined.select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))))
        .filter("a <> b").distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` (two longs), root being the least node it reaches.

    Self-loops, repeated and reversed edges and an empty table are allowed; edges with a null end are dropped.
    """
    now = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    said = None
    while True:
        now = written(_small_star(_large_star(now)), "edges")
        # Two rounds alike in count and hashes are the same star forest: the steps are deterministic.
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if state == said:
            break
        said = state
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
