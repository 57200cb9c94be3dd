"""Dataset-level summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ligatable.functions.scores import STRONG_CUT, pscale
from ligatable.operators.integrate import is_valid
from ligatable.operators.ordering import quartiles
from ligatable.sources.registry import SOURCES, AffinitySource, concentration_names, source_names

# Number of curve points and the decades they span, in nM.
CURVE_POINTS = 300
CURVE_FROM, CURVE_TO = -1, 5
FENCE = 1.5
AGREEMENT = 1.0
#: Sketches have two to this many registers; the standard error follows from that.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def pscale_curve(spark: SparkSession, points: int = CURVE_POINTS, cut: float = STRONG_CUT) -> DataFrame:
    """The p-scale at log-spaced concentrations, and whether it reaches the cut."""
    exponent = F.lit(CURVE_FROM) + F.col("id") * (CURVE_TO - CURVE_FROM) / (points - 1)
    return (
        spark.range(points)
        .select(F.col("id").alias("point"), F.pow(F.lit(10.0), exponent).alias("nanomolar"))
        .withColumn("pscale", pscale(F.col("nanomolar")))
        .withColumn("is_strong", F.col("pscale") >= cut)
    )


def pscale_curve_support(
    valid: DataFrame,
    points: int = CURVE_POINTS,
    cut: float = STRONG_CUT,
    sources: Sequence[AffinitySource] = SOURCES,
    digits: int | None = None,
) -> DataFrame:
    """The curve with the number of concentration measurements nearest to each point.

    Measurements beyond an end count at that end. Counting comes first: at most one
    row per point meets the curve. ``digits`` rounds the logarithm before.
    """
    exponent = F.log10("RawScore")
    place = ((exponent if digits is None else F.round(exponent, digits)) - CURVE_FROM) * (points - 1) / (CURVE_TO - CURVE_FROM)
    nearest = F.greatest(F.least(F.floor(place + 0.5), F.lit(points - 1)), F.lit(0)).cast("long")
    counts = (
        valid.filter(F.col("Source").isin(concentration_names(sources)))
        .groupBy(nearest.alias("point"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    curve = pscale_curve(valid.sparkSession, points, cut)
    return (
        curve.join(counts, "point", "left")
        .withColumn("measurements", F.coalesce("n", F.lit(0)).cast("long"))
        .drop("n")
    )


def overview_stats(pairs: DataFrame, edges: DataFrame, latest: DataFrame) -> DataFrame:
    """Headline numbers in one row; a metric that is missing or zero is null."""

    def shown(metric: str) -> Column:
        return latest.select(F.nullif(F.col(metric), F.lit(0.0)).alias(metric)).scalar().alias(metric)

    counted = pairs.agg(
        F.count_distinct("TargetID").alias("unique_targets"), F.count(F.lit(1)).alias("integrated_pairs")
    )
    n_edges = edges.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counted.select("*", n_edges.alias("ppi_edges"), *(shown(m) for m in ("rmse", "aupr")))


def source_sketches(rows: DataFrame, columns: Sequence[str] = ("DrugID", "TargetID")) -> DataFrame:
    """``Source`` and, for each column, a mergeable sketch of its distinct values; null values do not count.

    Store one such table a load: sketches of any loads and sources merge without their rows.
    """
    return rows.groupBy("Source").agg(*(F.hll_sketch_agg(c, F.lit(SKETCH_BITS)).alias(c) for c in columns))


def distinct_of_choices(
    sketches: DataFrame, choices: DataFrame, columns: Sequence[str] = ("DrugID", "TargetID")
) -> DataFrame:
    """About how many distinct values the sources of each choice hold together.

    ``choices (choice, Source)`` names them, once each; sources without a sketch add nothing, and a
    choice without any is left out. The standard error is ``SKETCH_ERROR`` of the value.
    """
    merged = choices.join(sketches, "Source").groupBy("choice")
    return merged.agg(*(F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns))


def exact_of_choices(rows: DataFrame, choices: DataFrame, column: str) -> DataFrame:
    """``(choice, column)``: the exact count that a sketch stands for, from all rows.

    Values shrink to the set of sources they occur in, so as many rows as there are such sets
    meet the choices; a value of several chosen sources counts once.
    """
    sets = (
        rows.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.array_sort(F.collect_set("Source")).alias("sources"))
        .groupBy("sources")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    met = sets.select("sources", "n", F.explode("sources").alias("Source")).join(choices, "Source")
    return met.select("choice", "sources", "n").distinct().groupBy("choice").agg(F.sum("n").alias(column))


def pairs_by_source(pairs: DataFrame) -> DataFrame:
    """Pairs each source contributes to, and its share of the sum over sources."""
    counts = pairs.select(F.explode("Sources").alias("Source")).groupBy("Source").agg(F.count(F.lit(1)).alias("pairs"))
    # a handful of rows by now, one per source
    total = F.sum("pairs").over(Window.partitionBy())
    return counts.withColumn("share", F.col("pairs") / total)


def cumulative_pairs(by_source: DataFrame, sources: Sequence[AffinitySource] = SOURCES) -> DataFrame:
    """Running total of pairs in integration order; one row per source, so the window is small."""
    position = F.array_position(F.array(*(F.lit(n) for n in source_names(sources))), F.col("Source"))
    ordered = by_source.withColumn("position", position.cast("int"))
    so_far = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return ordered.select("position", "Source", "pairs", F.sum("pairs").over(so_far).alias("cumulative"))


def _coverage(canonical: DataFrame) -> DataFrame:
    percent = F.count_if(is_valid()) * 100.0 / F.count(F.lit(1))
    return canonical.groupBy("Source").agg(percent.alias("coverage"))


def _reliability(normalized: DataFrame, sources: Sequence[AffinitySource], digits: int | None) -> DataFrame:
    """Share of a source's shared pairs where its mean score is close to the pair mean.

    One aggregate per pair holds sum and count of every source side by side, so a
    pair with very many rows shrinks on the map side and nothing is joined back.
    """
    names = source_names(sources)
    score = F.col("NormalizedScore")

    def of(name: str) -> Column:
        return F.when(F.col("Source") == name, score)

    sums = [F.sum(of(n)).alias(f"s{i}") for i, n in enumerate(names)]
    counts = [F.count(of(n)).alias(f"n{i}") for i, n in enumerate(names)]
    pairs = normalized.groupBy("DrugID", "TargetID").agg(F.avg(score).alias("mean"), *sums, *counts)
    present = reduce(Column.__add__, ((F.col(f"n{i}") > 0).cast("int") for i in range(len(names))))
    entries = F.array(
        *(
            F.struct(F.lit(n).alias("Source"), F.col(f"s{i}").alias("s"), F.col(f"n{i}").alias("n"))
            for i, n in enumerate(names)
        )
    )
    shared = pairs.filter(present > 1).select("mean", F.explode(entries).alias("e")).filter(F.col("e.n") > 0)
    away = F.abs(F.col("e.s") / F.col("e.n") - F.col("mean"))
    close = (away if digits is None else F.round(away, digits)) <= AGREEMENT
    return shared.groupBy(F.col("e.Source").alias("Source")).agg(
        (F.count_if(close) * 100.0 / F.count(F.lit(1))).alias("reliability")
    )


def _normalizability(normalized: DataFrame, sources: Sequence[AffinitySource]) -> DataFrame:
    """Share of scores inside the fences 1.5 interquartile ranges beyond the quartiles."""
    known = normalized.filter(F.col("Source").isin(source_names(sources))).select("Source", "AffinityScore")
    fences = quartiles(known, "Source", "AffinityScore")
    reach = (F.col("q3") - F.col("q1")) * FENCE
    inside = F.col("AffinityScore").between(F.col("q1") - reach, F.col("q3") + reach)
    share = F.count_if(inside) * 100.0 / F.count(F.lit(1))
    # fences: one row per registered source
    return known.join(F.broadcast(fences), "Source").groupBy("Source").agg(share.alias("normalizability"))


def source_quality(
    canonical: DataFrame,
    normalized: DataFrame,
    sources: Sequence[AffinitySource] = SOURCES,
    digits: int | None = None,
) -> DataFrame:
    """Coverage, reliability and normalizability per source, in percent.

    ``canonical`` holds all tagged rows, ``normalized`` the scored valid ones. ``digits``
    rounds the distance of scores before it is compared.
    """
    return (
        _coverage(canonical)
        .join(_reliability(normalized, sources, digits), "Source", "left")
        .join(_normalizability(normalized, sources), "Source", "left")
    )
