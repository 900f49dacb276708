"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialise


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, larger_only: bool, scratch: Scratch) -> DataFrame:
    """Link the neighbours b of each a to the least of a and its neighbours."""
    least = scratch(pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    joined = pairs.join(least, "a")
    if larger_only:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.where("a <> m").select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of edges (a, b).

    Loops and repeated edges do no harm. Minima are combined before the shuffle and the joins are plain
    equi-joins, which Spark splits at hub nodes; only two counters per step reach the driver. The result is a written
    table.
    """
    scratch = Scratch()
    current = scratch(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := _fingerprint(current)) != before:
        before = now
        if not now[0]:
            break
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = scratch(_star(both, larger_only=True, scratch=scratch))
        current = scratch(_star(large, larger_only=False, scratch=scratch))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = materialise(current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots))
    scratch.drop()
    return found
