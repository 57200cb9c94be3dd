"""Views over recommendations of all targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ligatable.functions.labels import human_looking
from ligatable.functions.scores import rounded_score
from ligatable.operators.model import TOP_DRUGS, topk_drugs
from ligatable.operators.skew import salted_join

# Chart length, histogram bins, points a trend needs.
CHART_ROWS = 10
HISTOGRAM_BINS = 15
TREND_MIN_POINTS = 3


def measured_recommendations(pairs: DataFrame, k: int = TOP_DRUGS) -> DataFrame:
    """Top ``k`` measured drugs per target, in the shape of learned recommendations."""
    return topk_drugs(pairs.select("TargetID", "DrugID", F.col("NormalizedScore").alias("score")), k)


def measured_evidence(nested: DataFrame, pairs: DataFrame) -> DataFrame:
    """The recommended drugs that are measured on their target, with rank, score and evidence.

    Both tables meet on the target alone, so where they are stored in equal buckets of it
    nothing is moved; the drug is then looked up in the few entries of the target.
    """
    entries = F.transform(
        "recommendations", lambda r: F.struct((-r["score"]).alias("o"), r["DrugID"].alias("d"), r["score"].alias("s"))
    )
    in_order = nested.select("TargetID", F.array_sort(entries).alias("_in_order"))
    rank = F.array_position(F.transform("_in_order", lambda r: r["d"]), F.col("DrugID"))
    return (
        pairs.join(in_order, "TargetID")
        .withColumn("Rank", rank.cast("int"))
        .filter(F.col("Rank") > 0)
        .select(
            "TargetID",
            "Rank",
            "DrugID",
            F.get("_in_order", F.col("Rank") - 1)["s"].alias("score"),
            "SourceCount",
            "EvidenceRows",
        )
    )


def ranked_recommendations(nested: DataFrame) -> DataFrame:
    """Array entries as rows with ``Rank`` from 1, by score and then id.

    The array itself is sorted, so rows never have to meet again to be ranked.
    """
    entries = F.transform(
        "recommendations", lambda r: F.struct((-r["score"]).alias("o"), r["DrugID"].alias("d"), r["score"].alias("s"))
    )
    return nested.select("TargetID", F.posexplode(F.array_sort(entries)).alias("i", "r")).select(
        "TargetID",
        (F.col("i") + 1).alias("Rank"),
        F.col("r.d").alias("DrugID"),
        rounded_score(F.col("r.s")).alias("PredictedScore"),
    )


def top_scores_head(ranked: DataFrame, n: int = CHART_ROWS) -> DataFrame:
    return ranked.filter(F.col("Rank") <= n)


def recommendation_count(targets: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Recommendations per target; a target without any has 0."""
    counts = recommendations.groupBy("TargetID").agg(F.count(F.lit(1)).alias("n"))
    return (
        targets.select("TargetID")
        .distinct()
        .join(counts, "TargetID", "left")
        .select("TargetID", F.coalesce("n", F.lit(0)).cast("long").alias("recommendations"))
    )


def score_histogram(recommendations: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins between a target's lowest and highest score; empty bins are left out."""
    extremes = recommendations.groupBy("TargetID").agg(
        F.min("score").alias("low"), F.max("score").alias("high"), F.count(F.lit(1)).alias("rows")
    )
    joined = salted_join(
        recommendations.select("TargetID", "DrugID", "score"),
        extremes.drop("rows"),
        "TargetID",
        counts=extremes.select("TargetID", "rows"),
    )
    span = F.col("high") - F.col("low")
    position = F.when(span > 0, F.floor((F.col("score") - F.col("low")) * bins / span)).otherwise(0)
    return (
        joined.withColumn("bin", (F.least(position, F.lit(bins - 1)) + 1).cast("int"))
        .groupBy("TargetID", "bin")
        .agg(F.count(F.lit(1)).alias("count"), F.min("low").alias("low"), F.max("high").alias("high"))
        .select(
            "TargetID",
            "bin",
            (F.col("low") + span * (F.col("bin") - 1) / bins).alias("bin_low"),
            (F.col("low") + span * F.col("bin") / bins).alias("bin_high"),
            "count",
        )
    )


def score_trend(ranked: DataFrame, rows: int | None = None) -> DataFrame:
    """Least-squares parabola of score over rank, as a fitted value per row.

    All ranks of a target enter, or the first ``rows``. A target has as many of them as
    recommendations were asked for, so a window over it is small. With ranks centred on their mean the normal equations solve in closed
    form. Fewer than three points give no trend.
    """
    target = Window.partitionBy("TargetID")
    u, y = F.col("_u"), F.col("PredictedScore")
    taken = ranked if rows is None else top_scores_head(ranked, rows)
    centred = taken.withColumn("_u", F.col("Rank") - F.avg("Rank").over(target))
    terms = {
        "_n": F.lit(1.0), "_s2": u * u, "_s3": u * u * u, "_s4": u * u * u * u,
        "_t0": y, "_t1": u * y, "_t2": u * u * y,
    }
    summed = centred.withColumns({name: F.sum(term).over(target) for name, term in terms.items()})
    n, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in terms)
    enough = n >= TREND_MIN_POINTS
    bend = (t2 - s2 * t0 / n - s3 * t1 / s2) / (s4 - s2 * s2 / n - s3 * s3 / s2)
    solved = summed.withColumn("_c", F.when(enough, bend))
    solved = solved.withColumn("_b", F.when(enough, (t1 - s3 * F.col("_c")) / s2))
    solved = solved.withColumn("_a", F.when(enough, (t0 - s2 * F.col("_c")) / n))
    trend = F.col("_a") + F.col("_b") * u + F.col("_c") * u * u
    return solved.select("TargetID", "Rank", "PredictedScore", trend.alias("Trend"))


def human_targets(targets: DataFrame) -> DataFrame:
    """Targets with a human-looking id, or all of them where no id looks human."""
    ids = targets.select("TargetID").distinct()
    looks_human = human_looking(F.col("TargetID"))
    return ids.filter(looks_human | ~targets.filter(looks_human).exists())


def list_targets(predictions: DataFrame, limit: int | None = None) -> DataFrame:
    """The distinct target ids; with ``limit``, the first so many in order."""
    ids = predictions.select("TargetID").distinct()
    return ids if limit is None else ids.orderBy("TargetID").limit(limit)
