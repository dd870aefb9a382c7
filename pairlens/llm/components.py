"""Connected components of a distributed edge table by repeated contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import join_split, split_of, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b): the smallest id reachable.

    Each round maps every node to its smallest neighbour or itself and contracts
    the edges accordingly.  A node that stays has only larger neighbours, so at
    least half of the nodes go in a round, and the smallest id of a component is
    never mapped away.  Every map is written to the shared folder; nothing but
    counts reaches the driver.  The edges of a hub are dealt over tasks when they
    meet its row of the map.
    """
    edges = stored(edges.select("a", "b").where("a <> b"), "edges")
    maps = []
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        near = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"), F.count("*").alias("degree")).withColumnRenamed("a", "id"), "map")
        step = near.select("id", "to")
        maps.append(step)
        hot = split_of(near, "id", "degree")
        at = lambda side: hot.withColumnRenamed("id", side) if hot is not None else None  # noqa: B023, E731
        moved = join_split(edges, step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a", "b", at("a"))
        moved = join_split(moved, step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b", "a", at("b"))
        edges = stored(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))

    def follow(found: DataFrame, step: DataFrame) -> DataFrame:
        nxt = step.select(F.col("id").alias("component"), F.col("to").alias("further"))
        return found.join(nxt, "component", "left").select("id", F.coalesce("further", "component").alias("component"))

    return reduce(follow, maps[1:], maps[0].withColumnRenamed("to", "component"))
