"""The star network around each target as edge and node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligatable.functions import labels, scores

TARGET, DRUG, NEIGHBOR = "target", "drug", "ppi"
DRUGS_SHOWN = 5


def drug_edges(recommendations: DataFrame, limit: int = DRUGS_SHOWN) -> DataFrame:
    """Edges to the best drugs of ``(TargetID, Rank, DrugID, score)``."""
    score = F.col("score").cast("double")
    return recommendations.filter(F.col("Rank") <= limit).select(
        "TargetID",
        F.lit(DRUG).alias("kind"),
        F.col("DrugID").alias("node"),
        score.alias("score"),
        scores.drug_edge_value(score).alias("strength"),
        scores.drug_edge_width(score).alias("width"),
    )


def neighbor_edges(neighbors: DataFrame) -> DataFrame:
    """Edges to the protein neighbours of ``(TargetID, NeighborID, ConfidenceScore)``."""
    confidence = F.col("ConfidenceScore")
    return neighbors.select(
        "TargetID",
        F.lit(NEIGHBOR).alias("kind"),
        F.col("NeighborID").alias("node"),
        confidence.alias("score"),
        scores.ppi_edge_value(confidence).alias("strength"),
        scores.ppi_edge_width(confidence).alias("width"),
    )


def edge_strength(recommendations: DataFrame, neighbors: DataFrame) -> DataFrame:
    """All drug and neighbour edges with their display strength and width."""
    return drug_edges(recommendations).unionByName(neighbor_edges(neighbors))


def network_edges(recommendations: DataFrame, neighbors: DataFrame) -> DataFrame:
    """The edges of targets that have recommendations, neighbours included."""
    drugs = drug_edges(recommendations)
    shown = drugs.select("TargetID").distinct()
    return drugs.unionByName(neighbor_edges(neighbors).join(shown, "TargetID", "left_semi"))


def network_nodes(edges: DataFrame) -> DataFrame:
    """The distinct nodes of each star with their display label.

    The target is added to the ends of its edges, so one pass over the edges gives
    all nodes.
    """
    centre = F.struct(F.lit(TARGET).alias("kind"), F.col("TargetID").alias("node"))
    nodes = edges.select("TargetID", F.explode(F.array(centre, F.struct("kind", "node"))).alias("n"))
    node = F.col("node")
    label = (
        F.when(F.col("kind") == TARGET, labels.display_label(node, labels.TARGET_LABEL))
        .when(F.col("kind") == DRUG, labels.display_label(node, labels.DRUG_LABEL))
        .otherwise(labels.display_label(node, labels.TARGET_LABEL, ellipsis=""))
    )
    return nodes.select("TargetID", "n.kind", "n.node").distinct().withColumn("label", label)
