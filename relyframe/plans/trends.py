"""Histories, rankings, moving averages and forecasts over scored versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relyframe.functions.scores import clamp
from relyframe.operators.quantiles import rank_in_groups
from relyframe.operators.relational import latest_per_key

SCORES = ["health_score", "quality_score", "anomaly_score", "drift_score"]
WINDOW = 3


def score_series(reports: DataFrame) -> DataFrame:
    """Long form: dataset_id, version_number, metric, value."""
    return reports.select("dataset_id", "version_number", *SCORES).unpivot(
        ["dataset_id", "version_number"], SCORES, "metric", "value"
    )


def moving_average(series: DataFrame, keys: list[str], order: str, value: str, window: int = WINDOW) -> DataFrame:
    """Mean of the newest ``window`` values; only those rows leave each task."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    tail = series.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= window)
    return tail.groupBy(*keys).agg(F.avg(value).alias("moving_average"))


def forecast(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Least-squares line over positions 0..n-1, read at n and clamped to 0..100.

    A single value is its own forecast. Positions come from a ranking that
    splits very long histories.
    """
    placed = rank_in_groups(series, keys, [F.asc(order)], "_pos").withColumn("_x", (F.col("_pos") - 1).cast("double"))
    fit = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(value, "_x").alias("slope"),
        F.regr_intercept(value, "_x").alias("intercept"),
        F.max(value).alias("sole"),
    )
    line = clamp(F.col("intercept") + F.col("slope") * F.col("n"))
    return fit.select(*keys, "n", F.when(F.col("n") == 1, F.col("sole")).otherwise(line).alias("forecast"))


def improvement(reports: DataFrame, score: str = "health_score") -> DataFrame:
    """Latest minus earliest score of each dataset."""
    return reports.groupBy("dataset_id").agg(
        (F.max_by(score, "version_number") - F.min_by(score, "version_number")).alias("improvement")
    )


def leaderboard_scores(reports: DataFrame, scorecards: DataFrame) -> DataFrame:
    """Six category scores per dataset: dataset_id, category, score."""
    newest = latest_per_key(reports, ["dataset_id"], [F.desc("version_number")])
    overall = scorecards.select("dataset_id", "version_number", "reliability_score")
    wide = (
        newest.join(overall, ["dataset_id", "version_number"], "left")
        .join(improvement(reports), "dataset_id")
        .select(
            "dataset_id",
            F.col("quality_score").alias("best_quality"),
            F.col("health_score").alias("best_health"),
            F.col("drift_score").alias("lowest_drift"),
            F.col("anomaly_score").alias("lowest_anomalies"),
            F.col("improvement").alias("most_improved"),
            F.coalesce("reliability_score", F.lit(0.0)).alias("best_overall"),
        )
    )
    return wide.unpivot(["dataset_id"], [c for c in wide.columns if c != "dataset_id"], "category", "score")


def leaderboard(board_scores: DataFrame) -> DataFrame:
    """Rank 1 is the highest score of a category; ties go by dataset id."""
    return rank_in_groups(board_scores, ["category"], [F.desc("score"), F.asc("dataset_id")])
