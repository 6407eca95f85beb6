"""Connected components by alternating large and small stars, as joins and sums over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipwatch.session import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the neighbours of each node at the least of them and the node itself."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = both.join(least, "a")
    if large:
        out = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def _sign(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, label): the least node of its component, for every node that is not its own label."""
    edges = stage(edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = _sign(edges)
    while True:
        edges = stage(_star(_star(edges, True), False), "stars")
        new = _sign(edges)
        if new == sign:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        sign = new
