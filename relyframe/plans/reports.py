"""The validation report: one scored row per dataset version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.functions import scores
from relyframe.operators import drift, profile, quality
from relyframe.sources import inputs
from relyframe.session import fact_table, together

KEYS = inputs.KEYS

# The rule set the reports are run with.
RULES = [
    (1, "Overall nulls HIGH", "NULL_PERCENT", 1.8, True),
    (2, "Duplicate rows CRITICAL", "DUPLICATE_PERCENT", 9.0, True),
    (3, "Price nulls MEDIUM", "COLUMN_NULL_PERCENT:o_totalprice", 5.8, True),
    (4, "Price floor", "COLUMN_MIN:o_totalprice", 1100.0, True),
    (5, "Price ceiling CRITICAL", "COLUMN_MAX:o_totalprice", 9000000.0, True),
    (6, "Status codes HIGH", "COLUMN_REGEX:o_orderstatus:[FO]", 32.5, True),
    (7, "Unique keys MEDIUM", "COLUMN_UNIQUE:o_orderkey", 7.0, True),
    (8, "Missing column", "COLUMN_NULL_PERCENT:o_comment", 5.0, False),
    (9, "Orders have lines HIGH", "REFERENTIAL:o_orderkey->lineitem:l_orderkey", 1.8, True),
    (10, "Switched off", "NULL_PERCENT", 0.0, False),
]


def summary_facts(spark: SparkSession, root: str) -> DataFrame:
    """Row, duplicate and missing-cell figures, shared by the rules and the scores."""
    return fact_table(spark, root, "summary", lambda: profile.table_summary(inputs.dirty_orders(spark, root), KEYS))


def violation_facts(spark: SparkSession, root: str) -> DataFrame:
    def build():
        targets = {"lineitem": inputs.table(spark, root, "lineitem")}
        return quality.violations(
            spark, inputs.dirty_orders(spark, root), KEYS, RULES, targets, summary_facts(spark, root)
        )

    return fact_table(spark, root, "violations", build)


def anomaly_facts(spark: SparkSession, root: str) -> DataFrame:
    """Outliers per column of each version, counted; the rows themselves are K02."""

    def build():
        d = inputs.dirty_orders(spark, root)
        return profile.outlier_counts(d, KEYS, profile.numeric_columns(d, KEYS)).select(
            *KEYS, "column_name", F.col("outlier_count").alias("anomaly_count")
        )

    return fact_table(spark, root, "anomalies", build)


def drift_facts(spark: SparkSession, root: str) -> DataFrame:
    def build():
        base = drift.pick_baselines(inputs.versions(spark, root))
        return drift.calculate_drift(inputs.dirty_orders(spark, root), base)

    return fact_table(spark, root, "drift", build)


def score_versions(summary: DataFrame, violations: DataFrame, anomalies: DataFrame, drifts: DataFrame) -> DataFrame:
    """Join the four branches, all already one row per version, and score them."""
    v = violations.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("violation_count"))
    a = anomalies.groupBy(*KEYS).agg(F.sum("anomaly_count").alias("anomaly_count"))
    d = drift.overall_drift(drifts)
    joined = (
        summary.join(v, KEYS, "left")
        .join(a, KEYS, "left")
        .join(d, KEYS, "left")
        .na.fill({"violation_count": 0, "anomaly_count": 0, "overall_drift_score": 0.0})
    )
    return scores.add_health(joined).withColumn("drift_score", scores.drift_score(F.col("overall_drift_score")))


def reports(spark: SparkSession, root: str) -> DataFrame:
    def build():
        summary, violations, anomalies, drifts = together(
            lambda: summary_facts(spark, root),
            lambda: violation_facts(spark, root),
            lambda: anomaly_facts(spark, root),
            lambda: drift_facts(spark, root),
        )
        return score_versions(summary, violations, anomalies, drifts).join(
            inputs.versions(spark, root).select(*KEYS, "created_at"), KEYS
        )

    return fact_table(spark, root, "reports", build)


def profiles(spark: SparkSession, root: str) -> DataFrame:
    return fact_table(spark, root, "profiles", lambda: profile.profile(inputs.dirty_orders(spark, root), KEYS))


def scorecards(spark: SparkSession, root: str) -> DataFrame:
    return scores.add_reliability(reports(spark, root))
