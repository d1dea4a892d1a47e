"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of an undirected edge table; component is the smallest node id of its component.

    Alternates large-star and small-star contraction, which ends in O(log^2 n) rounds whatever the diameter and keeps the edge
    count bounded by the input's. Every round is two aggregations by node; a star's centre is the only member of its list that
    matters, so no list of neighbours is ever collected and a hub is only a key with many rows, pre-aggregated before it is
    shuffled. Self loops and null ends are ignored; an empty table gives an empty result.
    """
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v"))
    e = cut(e.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        after = cut(small.select("x.*").where("u <> v").distinct())
        # a forest of stars: no centre is itself a leaf
        leaves = after.select(F.col("u").alias("n"))
        if after.join(leaves, after["v"] == leaves["n"], "left_semi").isEmpty() and after.groupBy("u").count().where("count > 1").isEmpty():
            e = after
            break
        e = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
