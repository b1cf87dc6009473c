"""Connected components of an edge table, by alternating star operations.

Large-star hangs every larger neighbour of a node on the smallest node of
its neighbourhood, small-star does the same for the smaller ones; both are
a minimum per node (combined before the shuffle) and a join back.  Every
round is written to the shared checkpoint folder.  A hub's edges are
spread by Spark's skew-join handling; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskwave.llm.common import materialise


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """``edges`` (u, v).  One star operation on it."""
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.unionByName(least.withColumnRenamed("m", "v"))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) with u <> v  ->  (node, root): root is the smallest node of
    the component; roots themselves are not listed."""
    edges = materialise(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = None
    while True:
        edges = materialise(_star(_star(edges, True), False), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
