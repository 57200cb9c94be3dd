"""Delimited inputs: affinity files and protein-protein links."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ligatable.sources.registry import SOURCES, AffinitySource

log = logging.getLogger(__name__)

SEPARATORS = {"tsv": "\t", "csv": ",", "ssv": " "}
PPI_COLUMNS = ("protein1", "protein2", "combined_score")


def _read_text_table(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    # Every column stays a string: inference would cost a pass over the data and
    # would turn the id "007" into 7.
    # Columns go by place, so a file of the folder with another header stops the read.
    return spark.read.csv(
        path, header=True, inferSchema=False, enforceSchema=False, sep=SEPARATORS.get(fmt, ","), escape='"'
    )


def _require(df: DataFrame, columns: Sequence[str], path: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}, found {df.columns}")
    return df


def read_affinity(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """One affinity file with a header, all columns as strings."""
    return _read_text_table(spark, path, fmt)


def available_sources(
    spark: SparkSession, folder: str, sources: Sequence[AffinitySource] = SOURCES
) -> list[tuple[AffinitySource, DataFrame]]:
    """The sources whose file exists; the others are skipped with a warning."""
    found = []
    for source in sources:
        path = f"{folder.rstrip('/')}/{source.file}"
        try:
            df = read_affinity(spark, path, source.format)
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            log.warning("source %s skipped, no file at %s", source.name, path)
            continue
        columns = (source.drug_col, source.target_col, source.score_col)
        found.append((source, _require(df, columns, path)))
    if not found:
        raise ValueError(f"none of the affinity sources exists in {folder}")
    return found


def read_ppi(spark: SparkSession, path: str) -> DataFrame | None:
    """Space-delimited protein links, or None (with a warning) where there is no file."""
    try:
        df = _read_text_table(spark, path, "ssv")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("no protein links at %s, step skipped", path)
        return None
    return _require(df, PPI_COLUMNS, path)
