"""Connected components of an edge table, as Spark joins and aggregations.

Alternating large-star and small-star steps (Kiveris et al., 2014): every step
links the neighbours of a node to the smallest of them. The number of rounds
grows with the logarithm of the longest chain, no step gathers the neighbours
of a node (only their minimum, which is pre-aggregated), and each round's
edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versio.llm.common import drop_written, unsent, written


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Link every neighbour that is larger than the node to the smallest of the node and its neighbours.
    ``n`` is the number of edges."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(unsent(least, n), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Link the node and its smaller neighbours to the smallest of these; edges come as a > b, ``n`` at most."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(unsent(least, n), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` (longs, either direction, repeats allowed) to one row ``node``, ``root`` for
    every node that has an edge to another node; ``root`` is the smallest node of its component.
    Rows with a null end or with equal ends link nothing. No edges: no rows."""
    ends = [F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b")]
    now = written(edges.where("a is not null and b is not null and a <> b").select(*ends).distinct(), "edges")
    before, after = None, _signature(now)
    while before != after and after[0]:
        stars = _small_star(_large_star(now, after[0]), after[0]).distinct()
        following = written(stars, "edges")
        drop_written(now)
        now, before, after = following, after, _signature(following)
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
