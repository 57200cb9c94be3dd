"""Quality of a scored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligatable.functions.scores import true_label
from ligatable.operators.model import AlsParams
from ligatable.operators.ordering import running_totals
from ligatable.operators.skew import salted_join


def baseline_predictions(training: DataFrame, test: DataFrame, digits: int | None = None) -> DataFrame:
    """Predict a test pair by the mean training score of its target, rounded if asked for."""
    mean = F.avg("NormalizedScore")
    means = training.groupBy("TargetID").agg(
        (mean if digits is None else F.round(mean, digits)).alias("prediction"), F.count(F.lit(1)).alias("rows")
    )
    scored = salted_join(
        test, means.select("TargetID", "prediction"), "TargetID", counts=means.select("TargetID", "rows")
    )
    return scored.select("DrugID", "TargetID", "NormalizedScore", "prediction")


def binarize_label(predictions: DataFrame) -> DataFrame:
    return predictions.withColumns(
        {"TrueLabel": true_label(F.col("NormalizedScore")), "prediction": F.col("prediction").cast("double")}
    )


def rmse(predictions: DataFrame) -> DataFrame:
    error = F.col("NormalizedScore") - F.col("prediction")
    return predictions.agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def aupr(labelled: DataFrame) -> DataFrame:
    """Area under the precision-recall curve of ``(TrueLabel, prediction)``.

    One curve point per distinct prediction, joined by straight lines, starting at
    recall 0 with the precision of the first point. The points are counted first
    and accumulated along a range-partitioned order.
    """
    points = labelled.groupBy("prediction").agg(
        F.sum(F.col("TrueLabel").cast("long")).alias("hits"), F.count(F.lit(1)).alias("rows")
    )
    curve = running_totals(points, [F.col("prediction").desc()], ["hits", "rows"])
    precision = F.col("cum_hits") / F.col("cum_rows")
    rows_before = F.col("cum_rows") - F.col("rows")
    hits_before = F.col("cum_hits") - F.col("hits")
    precision_before = F.when(rows_before > 0, hits_before / F.nullif(rows_before, F.lit(0))).otherwise(precision)
    area = F.sum(F.col("hits") * (precision + precision_before) / 2)
    return curve.agg(F.coalesce(area / F.nullif(F.max("cum_hits"), F.lit(0)), F.lit(0.0)).alias("aupr"))


def metrics_record(predictions: DataFrame, params: AlsParams = AlsParams()) -> DataFrame:
    """One row with the metrics and settings of a run, to append to a history."""
    labelled = binarize_label(predictions)
    return rmse(predictions).select(
        F.lit(params.algorithm).alias("algorithm"),
        "rmse",
        aupr(labelled).scalar().alias("aupr"),
        F.lit(params.rank).cast("long").alias("rank"),
        F.lit(params.reg).alias("regParam"),
        F.lit(params.iterations).cast("long").alias("maxIter"),
        F.lit(params.implicit).alias("implicitPrefs"),
        F.lit(params.drug_blocks).cast("long").alias("drugBlocks"),
        F.lit(params.target_blocks).cast("long").alias("targetBlocks"),
        F.current_timestamp().alias("timestamp"),
    )


def latest_metrics(history: DataFrame, ts: str = "timestamp", tie: str | None = None) -> DataFrame:
    """The newest record; no row where there is no record."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    newest = history.agg(F.max_by(F.struct(*history.columns), order).alias("r"))
    return newest.filter(F.col("r").isNotNull()).select("r.*")
