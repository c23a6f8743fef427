"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.session import staged


def _state(df: DataFrame) -> tuple:
    """Count and exact sums of two hashes: equal for equal tables, for others but by a chance beyond 2 ** -64."""
    sums = [F.sum(F.xxhash64(*key).cast("decimal(38,0)")) for key in (("u", "v"), ("v", "u"))]
    return tuple(df.agg(F.count(F.lit(1)), *sums).first())


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of long ids → (node, component): the smallest id reachable from each node.

    Each round links every node's larger neighbours to its smallest one, then its
    smaller neighbours likewise; the rounds needed grow with the logarithm of the longest path.
    Every round is written to the shared folder. Loops, doubled and null edges are ignored;
    a node without other edges is not returned.
    """
    edges = edges.filter("a is not null and b is not null and a <> b")
    state = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    seen = _state(state)
    while seen[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        state = staged(small, "stars")
        before, seen = seen, _state(state)
        if before == seen:
            break
    roots = state.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
