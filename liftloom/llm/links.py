"""Connected components of a table of links, by rounds of hooking to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftloom.session import written


def _both_ways(links: DataFrame) -> DataFrame:
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return links.union(turned)


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of its neighbours and itself."""
    sides = _both_ways(links)
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    downward = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = downward.groupBy("a").agg(F.min("b").alias("m"))
    moved = downward.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b")


def _settled(links: DataFrame) -> bool:
    """Whether every node is linked down to one other, which is linked down to none."""
    ends = links.selectExpr("a as node", "1 as down", "0 as up").union(links.selectExpr("b as node", "0 as down", "1 as up"))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).where("down > 1 or (down > 0 and up > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """The smallest node that each linked node can reach: columns ``node`` and ``root``.

    ``links`` has two long columns ``a`` and ``b``. Loops, repeated links and links with a null end change nothing.
    A node without links is not returned; no links give no rows. Each round is written to the shared folder and read
    back, so the plan stays short and a lost executor costs one round. A busy node only meets its neighbours in joins
    that adaptive execution can split; its own minimum is taken before the shuffle.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _settled(now):
        now = written(_small_star(_large_star(now)).distinct(), "links")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
