"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a partial aggregation and a join; nothing of the graph reaches
the driver but one row of checksums per round.  The table of minima is written
before it is joined, so that the adaptive planner can split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _joined_minima(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(x, y, m) with m the least of x and all its y, and the table (x, m)."""
    minima = cut(pairs.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m")))
    right = minima.withColumnRenamed("x", "__x")
    return pairs.join(right, pairs["x"] == right["__x"]).drop("__x"), minima


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns a, b of one type); root is the least node reachable.

    Nodes without an edge to another are not in the result; an empty table gives an empty one.
    """
    pairs = cut(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct()
    )
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
        joined, _ = _joined_minima(both)
        large = cut(joined.filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct())
        joined, minima = _joined_minima(large)
        small = joined.filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        pairs = cut(small.unionByName(minima.select("x", F.col("m").alias("y"))).distinct())
        now = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("x", "y")).alias("h"), F.sum(F.xxhash64("y", "x").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return pairs.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(
                pairs.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct()
            )
        before = now
