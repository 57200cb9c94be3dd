"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligatable.session import cut_lineage


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to its smallest one."""
    both = _both_ways(links)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node joins its smaller neighbours, and itself, to the smallest one."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, label)`` of every node in ``links (a, b)``; label is the smallest node.

    Links are two longs each; loops, nulls and repeats are ignored. Every round is two
    aggregations with partial minima and two joins, written to the shared folder, and
    the number of rounds grows with the logarithm of a component's size, not with its
    diameter. Nothing but a row count and a check sum comes to the driver.
    """
    links = (
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    links, before = cut_lineage(links), None
    while True:
        after = links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )
        before = after
        links = cut_lineage(_small_star(_large_star(links).distinct()).distinct())
