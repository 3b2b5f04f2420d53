"""Connected components of a link table, as a Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import maybe_broadcast, stored


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(``node``, ``class``) for each node of the links (``a``, ``b``): the class is the
    smallest node of its component.

    Each round links every node to the smallest node around it: a node's larger neighbours go
    to the smallest of it and its neighbours (large star), then its smaller neighbours and
    itself do (small star). The link count does not grow, a node with very many neighbours is
    aggregated with map-side combine, and the number of rounds grows with the logarithm of
    the longest chain. Each round is written to the shared folder; a round that changes
    nothing ends the loop. Nothing but two numbers a round reaches the driver. While the nodes
    are counted to be few, the aggregate is broadcast and a round has three shuffles.
    """
    ordered = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = stored(ordered.distinct(), "links")
    before = _state(links)
    for _ in range(rounds if before[0] else 0):
        links = stored(_round(links, 2 * before[0]), "links")
        now = _state(links)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("class")).union(links.select("b", "b").distinct())


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first())


def _round(links: DataFrame, nodes: int) -> DataFrame:
    """One large and one small star over links that have the larger node first."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    larger = both.filter("b > a").join(maybe_broadcast(around, nodes), F.col("a") == F.col("n"))
    large = larger.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    below = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
    small = large.join(maybe_broadcast(below, nodes), F.col("a") == F.col("n"))
    return small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct()
