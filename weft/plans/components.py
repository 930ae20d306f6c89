"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import removed, stored_at


def star_roots(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that links reach, for every node of an edge (a, b).

    A node hands its larger neighbours to its smallest one, then each node links its smaller
    neighbours to the smallest. Stars of a component merge until one is left, in a number of
    rounds logarithmic in its size; only keys and minima move, and a hub's rows are never
    gathered in one place. Rounds go on until the edges no longer change; the tables of a round
    are deleted after the next."""
    spark = edges.sparkSession

    def neighbours(e):
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def sums(e):
        return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()

    def star(rows, keep_equal):
        """(b, smallest neighbour of a) for each row; with keep_equal the nodes themselves join their star."""
        least = rows.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = rows.join(least, "a")
        out = out if keep_equal else out.filter(F.col("b") > F.col("a"))
        moved = out.select(F.col("b").alias("x"), F.col("m").alias("y"))
        if keep_equal:
            moved = moved.unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
        return (moved.filter(F.col("x") != F.col("y"))
                .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())

    now, now_at = stored_at(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                            .filter(F.col("a") != F.col("b")).distinct())
    last, seen = None, sums(now)
    while seen != last:
        half, half_at = stored_at(star(neighbours(now), False))
        new, new_at = stored_at(star(half, True))
        for folder in (now_at, half_at):
            removed(spark, folder)
        now, now_at = new, new_at
        last, seen = seen, sums(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """node, component (the smallest node reached), for all of ``nodes``. edges: a, b, undirected."""
    roots = star_roots(edges).withColumnRenamed("node", node)
    return nodes.select(node).join(roots, node, "left").select(node, F.coalesce("root", node).alias("component"))
