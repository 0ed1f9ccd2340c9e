"""Connected components of a graph that is only given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is joined to the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are joined to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of an edge (a, b), component being the smallest node reachable.

    Every step is written, so a lost executor costs no more than one step. It ends when a step changes nothing.
    """
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = scratch.save(edges.select("a", "b").where("a <> b").distinct(), f"{name}-0")
    seen, step = print_of(now), 0
    while seen[0]:
        step += 1
        now = scratch.save(_small_star(_large_star(now)), f"{name}-{step}")
        if step > 1:
            scratch.drop(f"{name}-{step - 1}")
        last, seen = seen, print_of(now)
        if tuple(last) == tuple(seen):
            break
    roots = now.select(F.col("b").alias("a"), "b").distinct()
    return now.select("a", "b").union(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))
