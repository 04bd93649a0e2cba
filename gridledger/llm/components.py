"""Connected components by alternating star operations, one saved table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.shared import forget, saved

ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each neighbour above a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its neighbours below it to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    below = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (u, v) names; component: the smallest node that is reachable.

    Loops and repeated edges don't matter; a null end drops the edge; no edges give no rows."""
    ordered = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, before = saved(ordered.distinct(), "edges"), None
    for _ in range(ROUNDS):
        state = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))"), F.expr("count(distinct u)")).first()
        if state == before or state[0] == 0:
            break
        before = state
        then, now = now, saved(_small_star(_large_star(now)), "edges")
        forget(then)
    else:
        raise RuntimeError(f"no components after {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
