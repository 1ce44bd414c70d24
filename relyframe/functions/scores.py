"""Score arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The score weights, penalties and cut-offs of the reports.
HEALTH_CAPS = {"null": 25.0, "duplicate": 25.0, "violation": 30.0, "anomaly": 20.0}
VIOLATION_POINTS, ANOMALY_POINTS = 5.0, 2.0
HEALTH_BANDS = [(90.0, "Healthy"), (75.0, "Warning"), (50.0, "Degraded")]
RELIABILITY_WEIGHTS = {"health_score": 0.4, "quality_score": 0.3, "drift_score": 0.2, "anomaly_score": 0.1}
RELIABILITY_BANDS = [(90.0, "excellent"), (75.0, "good"), (50.0, "warning")]
PLATFORM_WEIGHTS = {"quality_avg": 0.30, "health_avg": 0.25, "sla_compliance": 0.20, "freshness_score": 0.15, "stability": 0.10}
INTELLIGENCE_WEIGHTS = {
    "reliability": 0.25, "sla_compliance": 0.20, "governance_compliance": 0.20,
    "incident_stability": 0.15, "contract_compliance": 0.10, "workflow_success_rate": 0.10,
}
INTELLIGENCE_BANDS = [(90.0, "Excellent"), (75.0, "Good"), (50.0, "Warning")]
PRIORITY_WEIGHTS = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.2}
EVIDENCE_WEIGHTS = {
    "violation": 0.9, "anomaly": 0.8, "drift": 0.8, "incident": 1.0, "scorecard": 0.9, "sla": 0.9, "contract": 1.0,
}
CPU_MS_PRICE = 0.0001


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    # greatest() and least() skip nulls; a missing value stays missing.
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(x, F.lit(high))))


def band(x: Column, cuts: list[tuple[float, str]], lowest: str) -> Column:
    """The label of the first cut-off the value reaches."""
    out = F.lit(lowest)
    for cut, label in sorted(cuts):
        out = F.when(x >= cut, label).otherwise(out)
    return out


def lookup(x: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(x == k, F.lit(v)).otherwise(out)
    return out


def weighted(weights: dict[str, float]) -> Column:
    total = None
    for name, w in weights.items():
        term = F.col(name) * F.lit(w)
        total = term if total is None else total + term
    return total


def penalties(null_pct: Column, dup_pct: Column, n_viol: Column, n_anom: Column) -> dict[str, Column]:
    return {
        "null_penalty": F.least(null_pct, F.lit(HEALTH_CAPS["null"])),
        "duplicate_penalty": F.least(dup_pct, F.lit(HEALTH_CAPS["duplicate"])),
        "violation_penalty": F.least(n_viol * VIOLATION_POINTS, F.lit(HEALTH_CAPS["violation"])),
        "anomaly_penalty": F.least(n_anom * ANOMALY_POINTS, F.lit(HEALTH_CAPS["anomaly"])),
    }


def add_health(df):
    """Penalties, health, quality and anomaly scores, and the status."""
    df = df.withColumns(
        penalties(F.col("missing_cells_percent"), F.col("duplicate_rows_percent"), F.col("violation_count"), F.col("anomaly_count"))
    )
    lost = F.col("null_penalty") + F.col("duplicate_penalty") + F.col("violation_penalty") + F.col("anomaly_penalty")
    df = df.withColumns(
        {
            "health_score": clamp(100.0 - lost),
            "quality_score": F.greatest(F.lit(0.0), 100.0 - (F.col("null_penalty") + F.col("violation_penalty"))),
            "anomaly_score": F.greatest(F.lit(0.0), 100.0 - F.col("anomaly_penalty")),
        }
    )
    return df.withColumn("status", band(F.col("health_score"), HEALTH_BANDS, "Critical"))


def drift_score(overall: Column) -> Column:
    return F.greatest(F.lit(0.0), 100.0 - overall * 100.0)


def add_reliability(df):
    df = df.withColumn("reliability_score", clamp(weighted(RELIABILITY_WEIGHTS)))
    return df.withColumn("classification", band(F.col("reliability_score"), RELIABILITY_BANDS, "critical"))


def delay_minutes(actual: str, expected: str) -> Column:
    """Whole minutes late, never negative."""
    return F.greatest(F.lit(0), F.expr(f"timestampdiff(MINUTE, {expected}, {actual})")).cast("int")


def freshness_status(delay: Column) -> Column:
    return F.when(delay == 0, "on_time").when(delay < 60, "late").otherwise("critical")
