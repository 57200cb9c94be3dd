"""Score expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ligatable.sources.registry import SOURCES, AffinitySource, concentration_names

# Scaled range, constant-source score, positive label, strong-binding cut.
SCALE_LOW = 1.0
SCALE_SPAN = 4.0
CONSTANT_SOURCE_SCORE = 3.0
POSITIVE_SCORE = 3.0
STRONG_CUT = 6.52
# Upper bounds of the evidence tiers, each closed on the right.
TIERS: tuple[tuple[str, float], ...] = (("Low", 0.2), ("Medium", 0.4), ("High", 0.6), ("Very High", 1.0))


def pscale(nanomolar: Column) -> Column:
    """Negative log10 of the molar concentration, for a value in nM."""
    return F.lit(9.0) - F.log10(nanomolar)


def affinity_score(raw: Column, source: Column, sources: Sequence[AffinitySource] = SOURCES) -> Column:
    return F.when(source.isin(concentration_names(sources)), pscale(raw)).otherwise(raw)


def affinity_type(source: Column, sources: Sequence[AffinitySource] = SOURCES) -> Column:
    is_concentration = source.isin(concentration_names(sources))
    return F.when(is_concentration, F.concat(F.lit("p"), source)).otherwise(source)


def minmax_scaled(value: Column, low: Column, high: Column) -> Column:
    scaled = (value - low) / (high - low) * SCALE_SPAN + SCALE_LOW
    return F.when(high == low, F.lit(CONSTANT_SOURCE_SCORE)).otherwise(scaled)


def rounded_score(score: Column) -> Column:
    return F.round(F.coalesce(score.cast("double"), F.lit(0.0)), 4)


def true_label(score: Column) -> Column:
    return F.when(score >= POSITIVE_SCORE, 1.0).otherwise(0.0)


def drug_edge_value(score: Column) -> Column:
    return F.greatest(score * 4.0, F.lit(1.0))


def drug_edge_width(score: Column) -> Column:
    return F.greatest(score * 2.0, F.lit(1.0))


def ppi_edge_value(confidence: Column) -> Column:
    return F.greatest(confidence * 3.0, F.lit(0.5))


def ppi_edge_width(confidence: Column) -> Column:
    return F.greatest(confidence * 1.5, F.lit(0.5))


def disease_tier(score: Column) -> Column:
    """Evidence tier of a score in (0, 1]; null outside."""
    tier = F.when(score <= 0, F.lit(None).cast("string"))
    for name, upper in TIERS:
        tier = tier.when(score <= upper, F.lit(name))
    return tier
