"""Connected components of an edge table by contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); the component is
    its smallest node.

    Each round every node points to the smallest of itself and its neighbours, and
    the edges are rewritten to what their ends point to, so the graph shrinks by a
    constant factor at least.  Pointers of the rounds are composed at the end.  Every round
    is written to the shared folder.  Duplicates and self links are allowed; an empty
    table gives an empty one.
    """
    live = stored(_plain(edges))
    rounds: list[DataFrame] = []
    while True:
        ends = live.select(F.col("a").alias("node"), F.col("b").alias("to")).union(
            live.select(F.col("b").alias("node"), F.col("a").alias("to"))
        )
        points = stored(
            ends.groupBy("node").agg(F.min("to").alias("to"))
            .select("node", F.least("node", "to").alias("component"))
        )
        rounds.append(points)
        one = points.select(F.col("node").alias("a"), F.col("component").alias("na"))
        two = points.select(F.col("node").alias("b"), F.col("component").alias("nb"))
        moved = live.join(one, "a").select("na", "b")
        moved = moved.join(two, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
        live = stored(_plain(moved))
        if live.isEmpty():
            break
    found = rounds.pop()
    while rounds:
        below = rounds.pop()
        above = found.select(F.col("node").alias("component"), F.col("component").alias("_top"))
        found = below.join(above, "component", "left").select(
            "node", F.coalesce("_top", "component").alias("component")
        )
    return found


def _plain(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()
