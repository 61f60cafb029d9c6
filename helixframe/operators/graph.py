"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.storage import materialize

#: A node with more links than this, and over a ``MOST_HUBS``-th of all, is a hub; so there are at most 2 * MOST_HUBS of them.
HUB, MOST_HUBS = 10_000, 1024


def _below(rows: DataFrame, low: DataFrame, hub: int | None) -> DataFrame:
    """``rows`` with what ``low`` (``a, m, n``) says of their ``a``. Nodes of more than ``hub`` links come from a broadcast table, so that their rows stay where they are."""
    if hub is None:
        return rows.join(low.drop("n"), "a")
    large = F.broadcast(low.where(F.col("n") > hub).select("a", "m"))
    met = rows.join(large, "a", "left")
    rest = met.where("m is null").drop("m").join(low.where(F.col("n") <= hub).drop("n"), "a")
    return met.where("m is not null").unionByName(rest)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, hub: int = HUB) -> DataFrame:
    """``(node, component)`` for each node of ``edges``; component is the smallest node reachable.

    Alternating large-star and small-star passes: every pass is a pair of
    aggregates keyed by node and joins with them. Aggregates are combined
    map-side, and hubs, of which there is a bounded number, are joined by
    broadcast, so no task gathers the links of one node. The number of passes
    is logarithmic in the longest path. Null ends and self loops carry no link;
    nodes only in self loops come back as their own component.
    """
    raw = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    nodes = raw.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = materialize(raw.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        ends = links.select("a", F.xxhash64("a", "b").alias("h"), F.lit(1).alias("one")).unionAll(links.select(F.col("b").alias("a"), F.lit(0).cast("long"), F.lit(0)))
        degree = ends.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum("one").alias("m"), F.sum(F.col("h") % 1000003).alias("s"))
        n, total, most = degree.agg(F.coalesce(F.sum("m"), F.lit(0)), F.sum("s"), F.max("n")).first()
        if (n, total) == before or n == 0:
            break
        before = (n, total)
        least = max(hub, n // MOST_HUBS)
        bound = least if most > least else None
        # large star: hang every larger neighbour of a node below the smallest of its neighbourhood
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _below(both.where("b > a"), low, bound).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: hang the smaller neighbours, and the node itself, below the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _below(large, low, bound).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        links = materialize(small, "cc")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} passes")
    return nodes.join(links.select(F.col("a").alias("node"), "b"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))
