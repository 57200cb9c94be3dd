"""Protein-protein edges and the neighbours of a target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ligatable.operators.skew import salted_join

# Confidence cut, score scale, neighbours shown.
CONFIDENCE = 0.70
SCORE_SCALE = 1000.0
NEIGHBOR_LIMIT = 12
LOCAL, SECONDARY = "local", "secondary"


def ppi_confidence(links: DataFrame, threshold: float = CONFIDENCE, scale: float = SCORE_SCALE) -> DataFrame:
    """Links at or above the threshold, with the score brought to [0, 1].

    The cut is compared with the stored score, so that it reaches the scan.
    """
    score = F.col("combined_score")
    if isinstance(links.schema["combined_score"].dataType, StringType):
        score = score.try_cast("double")
    cut = round(threshold * scale, 9)
    return links.filter(score >= (int(cut) if cut == int(cut) else cut)).select(
        F.col("protein1").cast("string").alias("ProteinA"),
        F.col("protein2").cast("string").alias("ProteinB"),
        (score.cast("double") / scale).alias("ConfidenceScore"),
    )


def ppi_edges(confident: DataFrame) -> DataFrame:
    """One row per ordered pair, the best score kept."""
    return confident.groupBy("ProteinA", "ProteinB").agg(F.max("ConfidenceScore").alias("ConfidenceScore"))


def ppi_undirected(edges: DataFrame) -> DataFrame:
    """One row per unordered pair."""
    return edges.groupBy(
        F.least("ProteinA", "ProteinB").alias("ProteinA"), F.greatest("ProteinA", "ProteinB").alias("ProteinB")
    ).agg(F.max("ConfidenceScore").alias("ConfidenceScore"))


def _best_per(edges: DataFrame, key: str, other: str, n: int, rank: str) -> DataFrame:
    # rank <= n directly on the window lets Spark cut each group before the shuffle
    best_first = Window.partitionBy(key).orderBy(F.col("ConfidenceScore").desc(), F.col(other))
    return edges.withColumn(rank, F.row_number().over(best_first)).filter(F.col(rank) <= n)


def ppi_with_fallback(local: DataFrame, secondary: DataFrame) -> DataFrame:
    """Local edges, and the secondary edges of proteins that have no local edge.

    A secondary edge belongs to its ``ProteinA`` only. Copies are merged first, so a
    protein has at most one row a partner in the anti-join. ``ppi_neighbors`` takes the
    best of them.
    """
    proteins = local.select(F.explode(F.array("ProteinA", "ProteinB")).alias("ProteinA")).distinct()
    missing = ppi_edges(secondary).join(proteins, "ProteinA", "left_anti")
    columns = ["ProteinA", "ProteinB", "ConfidenceScore"]
    return (
        local.select(*columns)
        .withColumn("Origin", F.lit(LOCAL))
        .unionByName(missing.select(*columns).withColumn("Origin", F.lit(SECONDARY)))
    )


def ppi_neighbors(edges: DataFrame, targets: DataFrame | None = None, limit: int = NEIGHBOR_LIMIT) -> DataFrame:
    """The ``limit`` most confident distinct neighbours of each protein (or of each target).

    Each edge counts for both ends; an edge with ``Origin`` secondary for its first
    end only. Directions and copies are merged before the cut.
    """
    forward = F.struct(F.col("ProteinA").alias("TargetID"), F.col("ProteinB").alias("NeighborID"))
    backward = F.struct(F.col("ProteinB").alias("TargetID"), F.col("ProteinA").alias("NeighborID"))
    ends = F.array(forward, backward)
    if "Origin" in edges.columns:
        ends = F.when(F.col("Origin") == SECONDARY, F.array(forward)).otherwise(ends)
    merged = (
        edges.select(F.explode(ends).alias("e"), "ConfidenceScore")
        .groupBy("e.TargetID", "e.NeighborID")
        .agg(F.max("ConfidenceScore").alias("ConfidenceScore"))
        .filter(F.col("NeighborID") != "")
    )
    best = _best_per(merged, "TargetID", "NeighborID", limit, "NeighborRank")
    return best if targets is None else best.join(targets.select("TargetID").distinct(), "TargetID", "left_semi")


def target_ppi(targets: DataFrame, edges: DataFrame, id_map: DataFrame | None = None) -> DataFrame:
    """Edges that have the target at either end.

    Each edge is offered under both of its ends and met by one equi-join; an OR
    over two columns would become a nested loop. ``id_map`` is an optional
    ``(TargetID, ProteinID)`` table for targets under another id system.
    """
    wanted = targets.select("TargetID").distinct()
    if id_map is None:
        wanted = wanted.withColumn("ProteinID", F.col("TargetID"))
    else:
        wanted = wanted.join(id_map, "TargetID", "left").withColumn("ProteinID", F.coalesce("ProteinID", "TargetID"))
    ends = F.array_distinct(F.array("ProteinA", "ProteinB"))
    offered = edges.select(F.explode(ends).alias("ProteinID"), "ProteinA", "ProteinB", "ConfidenceScore")
    return salted_join(offered, wanted, "ProteinID").select("TargetID", "ProteinA", "ProteinB", "ConfidenceScore")
