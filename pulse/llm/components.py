"""Connected components of an edge table: alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) joined back to the
edges (a join that Spark can split on skew), so a hub with a third of all edges is
never gathered in one task.  Steps are written to the shared folder; rounds grow
with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import write_shared


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Link each neighbour ``v`` of ``u`` that ``keep`` allows to the smallest of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (pairs.filter(keep).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter(F.col("u") != F.col("v")))


def _flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("v").alias("u"), F.col("u").alias("v"))


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge between two different, non-null nodes (component: smallest node)."""
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    e = write_shared(e, "edges")
    before = _state(e)
    while before[0]:
        large = _star(e.union(_flipped(e)), F.col("v") > F.col("u")).distinct()
        # every u is now larger than its v: small-star links u and its smaller neighbours to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter(F.col("u") != F.col("v")).union(least.select("u", F.col("m").alias("v"))).distinct())
        e = write_shared(small, "edges")
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
