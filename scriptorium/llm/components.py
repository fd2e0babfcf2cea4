"""Connected components of a graph given by links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved


def _canonical(links: DataFrame) -> DataFrame:
    return links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (smallest id reachable) of every id that has a link to another one.

    Rounds of contraction: every node points to its smallest neighbour if that
    is smaller, pointers are followed to their roots by doubling, and links move
    to the roots; links inside one root drop out.  A round takes at least every
    second node out of the graph, and a chain of n nodes log n jumps.  The
    pointers of all rounds, applied one after the other, give the components.
    """
    links = saved(_canonical(edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v"))),
                  "graph")
    rounds = []
    while not links.isEmpty():
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = saved(both.groupBy("u").agg(F.min("v").alias("p")).filter("p < u"), "parents")
        while True:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            if parent.join(up, "p", "left_semi").isEmpty():
                break
            parent = saved(parent.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p")), "parents")
        rounds.append(parent)
        for end, other in (("u", "v"), ("v", "u")):
            moved = parent.withColumnRenamed("u", end)
            links = links.join(moved, end, "left").select(F.coalesce("p", end).alias(end), other)
        links = saved(_canonical(links), "graph")
    if not rounds:
        return links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    # a node leaves the graph with the round that gives it a parent; roots of one round may leave in a later one
    labels = None
    for parent in rounds:
        named = parent.select(F.col("u").alias("id"), F.col("p").alias("component"))
        if labels is None:
            labels = named
            continue
        moved = parent.select(F.col("u").alias("component"), "p")
        labels = labels.join(moved, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        labels = labels.unionByName(named)
    return saved(labels, "labels")
