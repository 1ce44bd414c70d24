"""Freshness, SLA, compliance, certification and platform-wide scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relyframe.functions import scores
from relyframe.operators.relational import latest_per_key
from relyframe.sources.inputs import KEYS

# SLA defaults, policy limits and certification cut-offs.
SLA_HOURS, SLA_QUALITY = 24, 95.0
MAX_VERSIONS, MIN_HEALTH = 5, 80.0
TIERS = [
    # level, health, quality, drift at most, SLA at least, open incidents at most
    ("platinum", 90.0, 90.0, 0.2, 100.0, 0),
    ("gold", 80.0, 80.0, 0.3, 90.0, 0),
    ("silver", 65.0, 65.0, 0.5, 0.0, 1),
]
CERTIFICATE_DAYS = 90
CRITICAL_POINTS, OPEN_POINTS, FAULT_POINTS = 15.0, 5.0, 10.0
REPORT_WEIGHTS = {"reliability": (0.35, 95.0), "incident": 0.25, "sla": 0.20, "trend": (0.20, 90.0)}


def freshness_log(refreshes: DataFrame) -> DataFrame:
    """Delay and status of each refresh."""
    df = refreshes.withColumn("delay_minutes", scores.delay_minutes("actual_time", "expected_time"))
    return df.withColumn("status", scores.freshness_status(F.col("delay_minutes")))


def freshness_metrics(log: DataFrame, datasets: DataFrame, key: str = "dataset_no") -> DataFrame:
    """Score from the latest delay, breach flag, and mean delay; no record counts as fresh."""
    last = F.max_by(F.struct("delay_minutes", "status"), F.struct("actual_time", "record_id"))
    facts = log.groupBy(key).agg(last.alias("last"), F.avg("delay_minutes").alias("avg_delay"))
    # greatest() skips nulls, so datasets without a record are set aside first.
    score = F.when(F.col("last").isNotNull(), F.greatest(F.lit(0.0), 100.0 - F.col("last.delay_minutes")))
    return datasets.join(facts, key, "left").select(
        *datasets.columns,
        F.coalesce(score, F.lit(100.0)).alias("freshness_score"),
        F.coalesce(F.col("last.status").isin("late", "critical"), F.lit(False)).alias("sla_breach"),
        F.coalesce(F.round("avg_delay", 2), F.lit(0.0)).alias("average_delay_minutes"),
        F.col("last.status").alias("latest_status"),
        F.col("last.delay_minutes").alias("latest_delay"),
    )


def newest_reports(versions: DataFrame, reports: DataFrame) -> DataFrame:
    """Latest version of each dataset with its report, if there is one."""
    newest = latest_per_key(versions, ["dataset_id"], [F.desc("version_number")])
    cols = [c for c in reports.columns if c not in (*KEYS, "created_at", "row_count")]
    return newest.join(reports.select(*KEYS, *cols), KEYS, "left")


def sla_compliance(datasets: DataFrame, versions: DataFrame, reports: DataFrame, as_of: str, targets: DataFrame | None = None) -> DataFrame:
    """Half for a fresh upload, half for the quality score; 0 without any version."""
    newest = newest_reports(versions, reports).select("dataset_id", "version_number", "created_at", "quality_score")
    df = datasets.select("dataset_id").join(newest, "dataset_id", "left")
    if targets is not None:
        df = df.join(targets, "dataset_id", "left")
    else:
        df = df.withColumn("target_hours", F.lit(None).cast("int")).withColumn("target_quality", F.lit(None).cast("double"))
    hours = F.coalesce("target_hours", F.lit(SLA_HOURS))
    fresh = F.col("created_at") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=hours)
    good = F.col("quality_score") >= F.coalesce("target_quality", F.lit(SLA_QUALITY))
    met = lambda c: F.coalesce(c, F.lit(False))
    return df.select(
        "dataset_id",
        met(fresh).alias("freshness_met"),
        met(good).alias("quality_met"),
        ((met(fresh).cast("int") + met(good).cast("int")) / 2 * 100.0).alias("compliance_pct"),
    )


def compliance(
    mappings: DataFrame, datasets: DataFrame, sensitivity: DataFrame, versions: DataFrame, freshness: DataFrame,
    contract_violations: DataFrame, reports: DataFrame,
) -> DataFrame:
    """Share of passed policies per dataset, with the failed and passed policy ids.

    Facts are one row per dataset, so each policy category is one expression.
    """
    n_versions = versions.groupBy("dataset_id").agg(F.count_distinct("version_number").alias("version_count"))
    newest = newest_reports(versions, reports).select(*KEYS, "health_score")
    faults = contract_violations.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("fault_count"))
    facts = (
        datasets.select("dataset_id")
        .join(sensitivity, "dataset_id", "left")
        .join(n_versions, "dataset_id", "left")
        .join(freshness.select("dataset_id", "latest_status"), "dataset_id", "left")
        .join(newest.join(faults, KEYS, "left"), "dataset_id", "left")
    )
    kind = F.col("category")
    failed = (
        F.when(kind == "PII Compliance", (F.col("pii_columns") > 0) & (F.col("sensitivity_level") == "PUBLIC"))
        .when(kind == "Retention Policy", F.col("version_count") > MAX_VERSIONS)
        .when(kind == "Freshness Policy", F.col("latest_status") == "critical")
        .when(kind == "Schema Governance", F.col("fault_count") > 0)
        .when(kind == "Quality Standards", F.col("health_score") < MIN_HEALTH)
    )
    failed = F.coalesce(failed, F.lit(False))
    judged = facts.join(mappings, "dataset_id", "left").withColumn("_failed", failed)
    ids = lambda cond: F.array_join(F.sort_array(F.collect_list(F.when(cond, F.col("policy_id")))), ",")
    has = F.col("policy_id").isNotNull()
    return judged.groupBy("dataset_id").agg(
        F.coalesce(F.try_divide(F.count_if(has & ~F.col("_failed")) * 100.0, F.count("policy_id")), F.lit(100.0)).alias("compliance_score"),
        ids(has & F.col("_failed")).alias("failed_policies"),
        ids(has & ~F.col("_failed")).alias("passed_policies"),
    )


def certification(
    datasets: DataFrame, versions: DataFrame, reports: DataFrame, sla: DataFrame, open_incidents: DataFrame, as_of: str
) -> DataFrame:
    """Tier of each dataset from its latest version; bronze when it has none.

    ``open_incidents``: dataset_id, version_number, open_count. Drift is the
    overall 0-1 figure.
    """
    newest = newest_reports(versions, reports).join(open_incidents, KEYS, "left")
    df = datasets.select("dataset_id").join(newest, "dataset_id", "left").join(sla.select("dataset_id", "compliance_pct"), "dataset_id", "left")
    df = df.select(
        "dataset_id",
        "version_number",
        F.coalesce("health_score", F.lit(100.0)).alias("health"),
        F.coalesce("quality_score", F.lit(100.0)).alias("quality"),
        F.coalesce("overall_drift_score", F.lit(0.0)).alias("drift"),
        F.coalesce("compliance_pct", F.lit(100.0)).alias("sla"),
        F.coalesce("open_count", F.lit(0)).alias("open_incidents"),
    )
    level = F.lit("bronze")
    for name, health, quality, drift, sla_min, open_max in reversed(TIERS):
        ok = (
            (F.col("health") >= health)
            & (F.col("quality") >= quality)
            & (F.col("drift") <= drift)
            & (F.col("sla") >= sla_min)
            & (F.col("open_incidents") <= open_max)
        )
        level = F.when(ok, name).otherwise(level)
    level = F.when(F.col("version_number").isNull(), "bronze").otherwise(level)
    until = F.lit(as_of).cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(CERTIFICATE_DAYS))
    note = F.format_string("health=%.1f, quality=%.1f, SLA=%.1f%%, incidents=%d", "health", "quality", "sla", "open_incidents")
    return df.select("dataset_id", level.alias("certification_level"), until.alias("expires_at"), note.alias("notes"))


def _stability(critical: Column, opened: Column) -> Column:
    return F.greatest(F.lit(0.0), 100.0 - critical * CRITICAL_POINTS - opened * OPEN_POINTS)


def reliability_facts(datasets: DataFrame, reports: DataFrame, sla: DataFrame, log: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row per dataset with sums and counts that add up to platform totals."""
    r = reports.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("reports"),
        *[F.sum(f"{s}_score").alias(f"{s}_sum") for s in ("quality", "health", "drift", "anomaly")],
    )
    f = log.groupBy("dataset_no").agg(F.count(F.lit(1)).alias("refreshes"), F.count_if(F.col("status") == "critical").alias("late"))
    opened = F.col("status") == "OPEN"
    i = incidents.groupBy("dataset_no").agg(
        F.count_if(opened).alias("open"), F.count_if(opened & (F.col("severity") == "critical")).alias("critical")
    )
    return (
        datasets.select("dataset_id", "dataset_no")
        .join(r, "dataset_id", "left")
        .join(sla.select("dataset_id", F.col("compliance_pct").alias("sla_pct")), "dataset_id", "left")
        .join(f, "dataset_no", "left")
        .join(i, "dataset_no", "left")
    )


def platform_reliability(facts: DataFrame, per_dataset: bool = True) -> DataFrame:
    """Weighted reliability overall and, through a rollup, for each dataset."""
    grouped = facts.rollup("dataset_id") if per_dataset else facts.groupBy()
    total = lambda c: F.sum(c)
    mean = lambda c, empty: F.coalesce(F.try_divide(total(c), total("reports")), F.lit(empty))
    zero = lambda c: F.coalesce(total(c), F.lit(0))
    df = grouped.agg(
        F.count(F.lit(1)).alias("datasets_monitored"),
        zero("open").alias("active_incidents"),
        zero("critical").alias("critical_incidents"),
        mean("quality_sum", 100.0).alias("quality_avg"),
        mean("health_sum", 100.0).alias("health_avg"),
        mean("drift_sum", 0.0).alias("drift_avg"),
        mean("anomaly_sum", 0.0).alias("anomaly_avg"),
        F.coalesce(F.avg("sla_pct"), F.lit(100.0)).alias("sla_compliance"),
        F.coalesce(100.0 - F.try_divide(total("late") * 100.0, total("refreshes")), F.lit(100.0)).alias("freshness_score"),
    )
    df = df.withColumn("stability", _stability(F.col("critical_incidents"), F.col("active_incidents")))
    df = df.withColumn("platform_score", scores.weighted(scores.PLATFORM_WEIGHTS))
    if per_dataset:
        df = df.withColumn("dataset_id", F.coalesce("dataset_id", F.lit("ALL")))
    return df


def intelligence_score(parts: DataFrame) -> DataFrame:
    """``parts``: one row with the six component scores."""
    df = parts.withColumn("score", scores.clamp(scores.weighted(scores.INTELLIGENCE_WEIGHTS)))
    return df.withColumn("rating", scores.band(F.col("score"), scores.INTELLIGENCE_BANDS, "Critical"))


def fault_score(count: Column) -> Column:
    """100 less ten points per open incident or violation."""
    return F.greatest(F.lit(0.0), 100.0 - count * FAULT_POINTS)


def report_quality(incident: Column, sla: Column) -> Column:
    w = REPORT_WEIGHTS
    return F.lit(w["reliability"][0] * w["reliability"][1] + w["trend"][0] * w["trend"][1]) + incident * w["incident"] + sla * w["sla"]
