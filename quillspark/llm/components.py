"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import broadcast_if_small, materialize


def connected_components(links: DataFrame, max_rounds: int = 60, rough_rounds: int | None = None) -> DataFrame:
    """node, component for the nodes of links(a, b); component is the smallest node reachable.

    With rough_rounds the work ends after so many rounds and every node has one of its true component's nodes, though
    not always the same one: enough where labels only spare comparisons.

    Distributed union-find: a large-star step hangs larger neighbours of a node on its smallest neighbour, a
    small-star step does so with the smaller ones; the number of rounds grows with the logarithm of a chain's
    length. Every round is written to the shared folder. Self links and repeated links do no harm; an empty
    table gives an empty result.
    """
    stars = materialize(_ordered(links.select("a", "b")))
    if rough_rounds is not None:
        for _ in range(rough_rounds):
            stars = materialize(_small_star(_large_star(stars)))
        return stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    before = _state(stars)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        stars = materialize(_small_star(_large_star(stars)))
        now = _state(stars)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected_components: no fixed point")
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _ordered(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _side(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _side(least: DataFrame) -> DataFrame:
    """A row for each node, written out: it is broadcast where small, and else Spark can split a hot node's links in the join."""
    return broadcast_if_small(materialize(least))


def _small_star(links: DataFrame) -> DataFrame:
    least = _side(links.groupBy("a").agg(F.min("b").alias("m")))
    hung = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
