"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from guardframe.llm.common import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node of its component.

    Large-star and small-star rounds [Kiveris et al., "Connected Components in MapReduce
    and Beyond", 2014] until the edges are stars. Every round is two aggregations and two
    joins on node keys; Spark splits the join partition of a hub. No edge goes to the
    driver but for one sum a round. An empty table gives an empty result.
    """
    now = durable(edges.where("a <> b").selectExpr("greatest(a, b) v", "least(a, b) m").distinct())
    seen = None
    while True:
        both = now.selectExpr("v u", "m w").union(now.selectExpr("m u", "v w"))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("w > u and w <> m").selectExpr("w v", "m").union(
            least.where("u <> m").selectExpr("u v", "m")
        )
        large = large.distinct()
        low = large.groupBy("v").agg(F.min("m").alias("r"))
        small = large.join(low, "v").where("m <> r").selectExpr("m v", "r m").union(low.selectExpr("v", "r m"))
        now = durable(small.distinct())
        state = now.agg(
            F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("v", "m")).alias("x"),
            F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")).alias("s"),
        ).first()
        if state == seen:
            break
        seen = state
    return now.selectExpr("v node", "m root").union(now.selectExpr("m node", "m root")).distinct()
