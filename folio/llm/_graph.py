"""Connected components by alternating large-star and small-star steps, each a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_scratch, materialise


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every neighbour of a node that is above it (large) or not (small) is linked to the least of its neighbourhood.

    The least comes from an aggregate, which combines before the shuffle, and goes back by a join, whose hot keys
    Spark can split; no neighbourhood is ever gathered in one row.
    """
    both = edges.select(F.col("v").alias("a"), F.col("u").alias("b"))  # u < v
    if large:
        both = both.unionByName(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = materialise(least, "least")  # a table, so that the join is between exchanges and Spark can split its hot keys
    on = both.join(least, "a")
    if large:
        out = on.where("b > a").select(F.col("m").alias("u"), F.col("b").alias("v"))
    else:
        out = on.select(F.col("m").alias("u"), F.col("b").alias("v")).unionByName(least.select(F.col("m").alias("u"), F.col("a").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; edges: (u, v) of one ordered type, any order, repeats allowed.

    The component is the least node that can be reached. Lineage is cut with a written table after each round.
    """
    e = materialise(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    state = _digest(e)
    while state[0]:
        new = materialise(_star(_star(e, True), False), "edges")
        drop_scratch(e)
        e, old, state = new, state, _digest(new)
        if state == old:
            break
    nodes = e.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return nodes.unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
