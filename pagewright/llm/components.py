"""Connected components of an edge list, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, settle, spread_join


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """`node` and `root`, the smallest node of its component, for every node of edges (`a`, `b`).

    First every node keeps only the edge to its smallest lesser neighbour, and
    its other lesser neighbours are tied to that one instead. Then each round
    hooks a node's root to the smallest root among its neighbours and follows
    roots twice, so chains halve; it ends when nothing changes. Every round is
    written to the shared checkpoint folder. Null ends are left out. Rows of a
    node with many neighbours, or of a root of many nodes, are dealt to several tasks.
    """
    pairs = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct())
    lows = settle(pairs.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")))
    tied = spread_join(pairs, lows.select("a", "low"), "a", hot_keys(lows, "a", "n", pairs.count()))
    tied = tied.select(F.col("b").alias("a"), F.col("low").alias("b")).union(lows.select("a", F.col("low").alias("b"))).distinct()
    both = settle(tied.union(tied.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))))
    roots = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"), F.count("*").alias("n")))
    # An edge stands in both directions, so a node is as often the one end as the other.
    busy, n_nodes = hot_keys(roots, "node", "n", both.count()).withColumnRenamed("node", "b"), roots.count()
    roots = roots.select("node", "root")
    for _ in range(rounds):
        near = spread_join(both, roots.select(F.col("node").alias("b"), "root"), "b", busy).groupBy("a").agg(F.min("root").alias("low"))
        # every node tells its root of the smallest root beside it
        told = (
            roots.join(near, roots["node"] == near["a"]).select(F.col("root").alias("node"), "low")
            .union(near.select(F.col("a").alias("node"), "low")).groupBy("node").agg(F.min("low").alias("low"))
        )
        hooked = roots.join(told, "node", "left").select("node", "root", F.least("root", F.coalesce("low", "root")).alias("up"))
        up = hooked.select(F.col("node").alias("up"), F.col("up").alias("higher"))
        large = hot_keys(roots.groupBy("root").agg(F.count("*").alias("n")), "root", "n", n_nodes).withColumnRenamed("root", "up")
        new = settle(
            spread_join(hooked, up, "up", large, "left").select("node", F.least("up", F.coalesce("higher", "up")).alias("root"), F.col("root").alias("was"))
        )
        changed = new.filter("root <> was").limit(1).count()
        roots = new.select("node", "root")
        if not changed:
            return roots
    raise RuntimeError(f"components did not settle within {rounds} rounds")
