"""The two batch jobs: integrate the sources, then train and recommend.

    python -m ligatable.plans.jobs integrate <data folder> <store folder>
    python -m ligatable.plans.jobs add <data folder> <store folder> <name of the load>
    python -m ligatable.plans.jobs train <store folder>
"""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligatable.operators import evaluate, integrate, model, ppi
from ligatable.session import build_session, cut_lineage, drop_staged, staging_path
from ligatable.sources import files, tables

# Names of the stored tables and of the protein link file.
INTEGRATED = "integrated_interactions"
PARTIALS = "partial_scores"
REJECTS = "rejected_rows"
REJECT_REPORT = "reject_report"
PPI_EDGES = "string_ppi_edges"
METRICS = "model_metrics"
PREDICTIONS = "predicted_interactions"
PPI_FILE = "9606.protein.links.v12.0.txt"


def stored(spark: SparkSession, store: str, name: str, fmt: str = "parquet") -> DataFrame:
    return tables.load_table(spark, f"{store}/{name}", fmt)


def integrate_sources(spark: SparkSession, data: str, store: str, fmt: str = "parquet") -> DataFrame:
    """Write the integrated pairs, the rejected rows and the protein edges; returns the row report.

    Text is parsed once: the scored rows are written in columns, with the rule that each breaks
    if any, and then read for the extremes, the pairs and the rejects. They go at the end.
    """
    rows = integrate.check_sources(files.available_sources(spark, data))
    path = staging_path(spark, "scored")
    try:
        tables.save_table(integrate.score_affinity(rows), path)
        checked = tables.load_table(spark, path)
        pairs = integrate.integrated_pairs(integrate.minmax_by_source(integrate.accepted_rows(checked)))
        tables.save_table(pairs, f"{store}/{INTEGRATED}", fmt)
        rejects = integrate.rejected_rows(checked).select("Source", "Rule", "DrugID", "TargetID", "ScoreText")
        tables.save_table(rejects, f"{store}/{REJECTS}", fmt)
        tables.save_table(integrate.reject_report(checked), f"{store}/{REJECT_REPORT}", fmt)
    finally:
        drop_staged(spark, path)
    links = files.read_ppi(spark, f"{data}/{PPI_FILE}")
    if links is not None:
        tables.save_table(ppi.ppi_edges(ppi.ppi_confidence(links)), f"{store}/{PPI_EDGES}", fmt)
    return integrate.dedup_report(stored(spark, store, INTEGRATED, fmt))


def add_load(spark: SparkSession, data: str, store: str, load: str, fmt: str = "parquet") -> DataFrame:
    """Add the source files in ``data`` to the store as ``load``; returns the row report.

    Only the new files are read, and the stored sums by pair and source: extremes that moved and
    pairs that gained rows come out as if all files had been integrated at once. A source may
    come in several loads. A load that is stored already is refused, as its rows would count
    twice; if only the pairs after it are missing, ``refresh_pairs`` makes them.
    """
    if load in stored_loads(spark, store, fmt):
        raise ValueError(f"load {load!r} is stored already")
    rows = integrate.load_sources(files.available_sources(spark, data))
    sums = integrate.partial_scores(integrate.score_affinity(rows)).withColumn("Load", F.lit(load))
    tables.save_table(sums, f"{store}/{PARTIALS}", fmt, mode="append")
    return refresh_pairs(spark, store, fmt)


def refresh_pairs(spark: SparkSession, store: str, fmt: str = "parquet") -> DataFrame:
    """Write the integrated pairs of all stored loads anew; returns the row report."""
    pairs = integrate.pairs_of_partials(stored(spark, store, PARTIALS, fmt))
    tables.save_table(pairs, f"{store}/{INTEGRATED}", fmt)
    return integrate.dedup_report(stored(spark, store, INTEGRATED, fmt))


def stored_loads(spark: SparkSession, store: str, fmt: str = "parquet") -> list[str]:
    """The names of the loads in the store, one row each."""
    try:
        sums = stored(spark, store, PARTIALS, fmt)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(row.Load for row in sums.select("Load").distinct().collect())


def train_and_recommend(
    spark: SparkSession, store: str, fmt: str = "parquet", params: model.AlsParams = model.AlsParams()
) -> DataFrame:
    """Train on the stored pairs, append the metrics, write the recommendations; returns the metrics."""
    fitted = model.fit_recommender(integrate.training_pairs(stored(spark, store, INTEGRATED, fmt)), params)
    metrics = cut_lineage(evaluate.metrics_record(cut_lineage(fitted.predictions()), params))
    tables.save_table(metrics, f"{store}/{METRICS}", fmt, mode="append")
    tables.save_table(fitted.recommendations(), f"{store}/{PREDICTIONS}", fmt, cluster_by=["TargetID"])
    return metrics


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="job", required=True)
    integrating = commands.add_parser("integrate")
    integrating.add_argument("data")
    adding = commands.add_parser("add")
    adding.add_argument("data")
    training = commands.add_parser("train")
    for command in (integrating, adding, training):
        command.add_argument("store")
        command.add_argument("--format", default="parquet")
    adding.add_argument("load")
    args = parser.parse_args(argv)
    spark = build_session(f"ligatable-{args.job}")
    if args.job == "integrate":
        integrate_sources(spark, args.data, args.store, args.format).show(truncate=False)
    elif args.job == "add":
        add_load(spark, args.data, args.store, args.load, args.format).show(truncate=False)
    else:
        train_and_recommend(spark, args.store, args.format).show(truncate=False)


if __name__ == "__main__":
    main()
