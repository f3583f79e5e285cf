"""Connected components by alternating large-star and small-star steps.

Every step is a join or an aggregate over links; nothing is gathered. Each round
is written to the shared folder, so lineage stays short and executors can go. Links
are few beside documents: the tasks of a round follow from their number, and are
not as many as the session's shuffles have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tasks, written


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """Large: each neighbour above a node links to the smallest of the node and its neighbours; small: the node and those below it do."""
    if large:
        near = edges.selectExpr("inline(array(struct(a AS node, b AS other), struct(b AS node, a AS other)))")
    else:
        near = edges.selectExpr("greatest(a, b) AS node", "least(a, b) AS other")
    least = near.groupBy("node").agg(F.min("other").alias("low")).selectExpr("node", "least(node, low) AS low")
    joined = near.join(least, "node")
    moved = joined.filter("other > node").selectExpr("other AS a", "low AS b") if large else joined.filter("other != low").selectExpr("other AS a", "low AS b").unionByName(least.selectExpr("node AS a", "low AS b"))
    return moved.filter("a != b").coalesce(parts).distinct().coalesce(parts)


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) of every node that has a link; edges has columns a, b.

    Ends when a round changes no link: after about the logarithm of the longest
    path. Raises if `rounds` are not enough, rather than return part of the links.
    """
    now = written(edges.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").filter("a != b").distinct(), "links")
    sign = None
    for _ in range(rounds):
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(new) == sign or not new[0]:
            break
        sign = tuple(new)
        parts = tasks(now.sparkSession, new[0])
        now = written(_star(_star(now, True, parts), False, parts), "links")
    else:
        raise RuntimeError(f"links still change after {rounds} rounds")
    return now.selectExpr("a AS node", "b AS root").unionByName(now.selectExpr("b AS node", "b AS root")).distinct()
