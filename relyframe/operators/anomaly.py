"""Outlier detectors that work column by column: z-score and IQR."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relyframe.operators.keyed import match
from relyframe.operators.profile import iqr_bounds, long_numbers, numeric_columns
from relyframe.session import with_broadcast

Z_LIMIT = 3.0


def zscore_anomalies(df: DataFrame, keys: list[str], row_key: list[str], threshold: float = Z_LIMIT) -> DataFrame:
    """Values further than ``threshold`` sample deviations from the mean of their group."""
    by = [*keys, "column_name"]
    cols = numeric_columns(df, keys)
    ids = [f"_k{i}" for i in range(len(row_key))]
    base = df.select(*keys, *[F.col(k).alias(i) for k, i in zip(row_key, ids)], *cols)
    rows = long_numbers(base, [*keys, *ids], cols)
    stats = with_broadcast(
        long_numbers(base, keys, cols)
        .groupBy(*by)
        .agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
        .where("n > 2 AND std > 0")
    )
    z = F.abs(F.col("value") - F.col("mean")) / F.col("std")
    return (
        match(rows, stats, by)
        .withColumn("score", z)
        .where(F.col("score") > threshold)
        .select(*by, *[F.col(i).alias(k) for k, i in zip(row_key, ids)], "score", F.lit("Z_SCORE").alias("anomaly_type"), "value", "mean", "std")
    )


def iqr_anomalies(df: DataFrame, keys: list[str], row_key: list[str], bounds: DataFrame | None = None) -> DataFrame:
    """Values outside the 1.5-IQR fence, scored by their distance from the median."""
    by = [*keys, "column_name"]
    cols = numeric_columns(df, keys)
    ids = [f"_k{i}" for i in range(len(row_key))]
    base = df.select(*keys, *[F.col(k).alias(i) for k, i in zip(row_key, ids)], *cols)
    fence = with_broadcast(iqr_bounds(base, keys, cols) if bounds is None else bounds)
    v = F.col("value")
    spread = F.when(F.col("iqr") > 0, F.col("iqr")).otherwise(F.lit(1.0))
    return (
        match(long_numbers(base, [*keys, *ids], cols), fence, by)
        .where((v < F.col("lower_bound")) | (v > F.col("upper_bound")))
        .select(
            *by,
            *[F.col(i).alias(k) for k, i in zip(row_key, ids)],
            (F.abs(v - F.col("median")) / spread).alias("score"),
            F.lit("IQR").alias("anomaly_type"),
            "value",
            "lower_bound",
            "upper_bound",
        )
    )
