"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshop.llm.storage import fitted, saved_small


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every id in ``edges``; a component is named by its smallest id.

    Alternates large stars and small stars (each neighbour is tied to the smallest one seen)
    until every node hangs on one root; the number of rounds grows with the logarithm of the
    longest chain, and a graph of stars needs none. A node's neighbours are never gathered: a
    round takes one minimum per node, combined before the shuffle, and one join back. Each
    round is saved, in as many partitions as its edges need; they never grow. Edges from a node
    to itself, repeated edges and either direction are fine; nulls are ignored; no edges give
    no rows.
    """
    now, rows = saved_small(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where("hi <> lo")
        .distinct()
    )
    while not _stars(now):
        both = now.union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m"))
        least = fitted(least.select(F.col("hi").alias("node"), F.least("hi", "m").alias("m")), 2 * rows)
        # large star: every neighbour above a node moves to the least of the node's surroundings
        large = fitted(
            now.withColumnRenamed("lo", "node").join(least, "node").select("hi", F.col("m").alias("lo")),
            rows,
        )
        # small star: the neighbours below a node, and the node, move to the least of them
        small = fitted(large.groupBy("hi").agg(F.min("lo").alias("m")), rows)
        moved = large.join(small, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        ties = moved.where("hi <> lo").union(small.select("hi", F.col("m").alias("lo")))
        now, rows = saved_small(fitted(ties, 2 * rows).distinct())
    stars = now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return stars.union(now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every upper end has one lower end, which is nobody's upper end."""
    ends = edges.select(F.col("hi").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("lo", F.lit(0), F.lit(1))
    )
    odd = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return odd.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()
