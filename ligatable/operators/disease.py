"""Protein annotation and disease associations of targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ligatable.functions import payloads
from ligatable.functions.scores import TIERS, disease_tier
from ligatable.operators.skew import one_per, salted_join

NOT_HUMAN, NO_GENE, NO_ASSOCIATIONS, OK = "not_human", "no_gene", "no_associations", "ok"
# Entries shown, source names of status rows.
ENTRIES_SHOWN = 12
STATUS_SOURCE = {NOT_HUMAN: "Not applicable", NO_GENE: "UniProt", NO_ASSOCIATIONS: "DisGeNET (no records)"}


def target_annotation(targets: DataFrame, proteins: DataFrame) -> DataFrame:
    """Name, organism, gene and human flag of each target, with defaults for unknown targets.

    Of several rows for one accession the smallest counts.
    """
    facts = one_per(proteins, "accession", "protein_name", "organism", "gene_symbol", "is_human").withColumnRenamed(
        "accession", "TargetID"
    )
    return (
        targets.select("TargetID")
        .distinct()
        .join(facts, "TargetID", "left")
        .select(
            "TargetID",
            F.coalesce("protein_name", F.lit(payloads.UNKNOWN)).alias("protein_name"),
            F.coalesce("organism", F.lit(payloads.UNKNOWN)).alias("organism"),
            "gene_symbol",
            F.coalesce("is_human", F.lit(False)).alias("is_human"),
        )
    )


def gene_key(gene_id: Column, gene_symbol: Column) -> Column:
    """Associations are looked up by gene id, or by the symbol where there is none."""
    return F.coalesce(gene_id.cast("string"), gene_symbol)


def with_gene_key(annotated: DataFrame, gene_ids: DataFrame) -> DataFrame:
    """Add the ``gene_key`` of human targets that have a gene; null for the others.

    The views below read the result several times: store it first.
    """
    named = F.when(F.col("is_human") & (F.col("gene_symbol") != ""), F.col("gene_symbol"))
    ids = gene_ids.groupBy(F.col("gene_symbol").alias("_gene")).agg(F.min("gene_id").alias("gene_id"))
    return (
        salted_join(annotated.withColumn("_gene", named), ids, "_gene", "left")
        .withColumn("gene_key", gene_key(F.col("gene_id"), F.col("_gene")))
        .drop("_gene", "gene_id")
    )


def associations_by_gene(rows: DataFrame) -> DataFrame:
    """Table rows as ``(gene_key, Gene, Disease, Score, Source)`` under the payload rules."""
    return rows.select(
        gene_key(F.col("ncbi_id"), F.col("gene_symbol")).alias("gene_key"),
        F.col("gene_symbol").alias("Gene"),
        payloads.disease_name(F.col("disease_name"), F.col("disease_id")).alias("Disease"),
        payloads.disease_score(F.col("score"), F.col("gda_score")).alias("Score"),
        payloads.disease_source(F.col("source")).alias("Source"),
    )


def _message() -> Column:
    human_only = F.concat("protein_name", F.lit(" is not human ("), "organism", F.lit("); associations cover human genes"))
    no_gene = F.concat(F.lit("no gene symbol for human protein "), "TargetID")
    nothing = F.concat(F.lit("no disease associations for gene "), "gene_symbol")
    status = F.col("status")
    return F.when(status == NOT_HUMAN, human_only).when(status == NO_GENE, no_gene).when(status == NO_ASSOCIATIONS, nothing)


def _targets_by_gene(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("gene_key").agg(F.count(F.lit(1)).alias("rows"))


def disease_status(keyed: DataFrame, associations: DataFrame) -> DataFrame:
    """Outcome of the lookup per target, with a message where there is nothing to show.

    Associations enter as one row per gene, so a gene with very many of them does
    not matter here.
    """
    genes = associations.select("gene_key").distinct().withColumn("_found", F.lit(True))
    status = (
        F.when(~F.col("is_human"), NOT_HUMAN)
        .when(F.col("gene_key").isNull(), NO_GENE)
        .when(F.col("_found").isNull(), NO_ASSOCIATIONS)
        .otherwise(OK)
    )
    looked_up = salted_join(keyed, genes, "gene_key", "left", counts=_targets_by_gene(keyed)).withColumn("status", status)
    return looked_up.select("TargetID", "gene_symbol", "status", _message().alias("message"))


def disease_associations(keyed: DataFrame, associations: DataFrame) -> DataFrame:
    """All associations of each target, and one explaining row for a target without any.

    Both tables are read several times: pass stored ones.
    """
    genes = keyed.select("TargetID", F.col("gene_symbol").alias("Gene"), "gene_key")
    counts = associations.groupBy("gene_key").agg(F.count(F.lit(1)).alias("rows"))
    found = salted_join(associations.drop("Gene"), genes, "gene_key", counts=counts).select(
        "TargetID", F.lit(OK).alias("status"), "Gene", "Disease", "Score", "Source"
    )
    status = disease_status(keyed, associations).filter(F.col("status") != OK)
    source = F.when(F.lit(False), F.lit(""))
    for name, text in STATUS_SOURCE.items():
        source = source.when(F.col("status") == name, F.lit(text))
    explained = status.select(
        "TargetID",
        "status",
        F.when(F.col("status") == NO_ASSOCIATIONS, F.col("gene_symbol")).otherwise(F.lit("—")).alias("Gene"),
        F.col("message").alias("Disease"),
        F.lit(None).cast("double").alias("Score"),
        source.alias("Source"),
    )
    return found.unionByName(explained)


def top_diseases(associations: DataFrame, limit: int = ENTRIES_SHOWN) -> DataFrame:
    """The ``limit`` best scored associations per gene; rows without a score are left out."""
    best_first = Window.partitionBy("gene_key").orderBy(F.col("Score").desc(), F.col("Disease"), F.col("Source"))
    return (
        associations.filter(F.col("Score").isNotNull())
        .withColumn("Rank", F.row_number().over(best_first))
        .filter(F.col("Rank") <= limit)
    )


def disease_tier_counts(keyed: DataFrame, associations: DataFrame) -> DataFrame:
    """Associations per evidence tier for targets that have a score; empty tiers count 0.

    Tiers are counted per gene before any target is joined, and the four counts are
    then turned into rows.
    """
    names = [name for name, _ in TIERS]
    tier = disease_tier(F.col("Score"))
    per_gene = (
        associations.filter(F.col("Score").isNotNull())
        .groupBy("gene_key")
        .agg(*(F.count_if(tier == name).alias(name) for name in names))
    )
    rows = keyed.select("TargetID", "gene_key")
    wide = salted_join(rows, per_gene, "gene_key", counts=_targets_by_gene(keyed)).select("TargetID", *names)
    return wide.unpivot("TargetID", [F.col(f"`{name}`") for name in names], "Tier", "Count")
