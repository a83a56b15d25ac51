"""Connected components by alternating stars, for graphs that no one machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from formbook.session import checkpointed


def components(edges: DataFrame, a: str, b: str, rounds: int = 60, settle: bool = True) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges``, for each node that has an edge.

    Large stars tie larger neighbours to the smallest one, small stars tie smaller ones; both keep components whole and end, after
    a number of rounds that grows with the logarithm of the nodes, in one star per component. Each round is written to the
    shared checkpoint folder, and its size and sum are taken while it is written. A node's smallest neighbour is a combined minimum, and its edges meet it
    in a join. With ``settle=False`` the work ends after ``rounds``: nodes of one component may then have several labels, but one label is never in two components. Loops are ignored.
    """
    e, state = _written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    for _ in range(rounds):
        if state[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "_u")
        large = both.join(least, F.col("u") == F.col("_u")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
        joined = large.join(small_least, F.col("u") == F.col("_u"))
        small = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
        e, now = _written(small.where(F.col("u") != F.col("v")).distinct())
        if now == state:
            break
        state = now
    else:
        if settle:
            raise RuntimeError("components did not settle")
    return e.unionByName(e.select(F.col("v").alias("u"), "v")).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _written(e: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, with their count and a sum that tells one set from another."""
    facts = Observation()
    out = checkpointed(e.observe(facts, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")))
    return out, (facts.get["n"], facts.get["s"])
