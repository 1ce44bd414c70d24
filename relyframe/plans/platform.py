"""Facts and composed reports over the derived datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.operators import schema
from relyframe.plans import contracting, governance, insight, reports, trends
from relyframe.session import fact_table
from relyframe.sources import inputs
from relyframe.sources.tables import table

KEYS = inputs.KEYS
POLICIES = ["PII Compliance", "Retention Policy", "Freshness Policy", "Schema Governance", "Quality Standards"]


def one_row(parts: dict[str, DataFrame]) -> DataFrame:
    """One row from several one-value frames, without joining them."""
    rows = [d.toDF("value").select(F.lit(n).alias("name"), F.col("value").cast("double").alias("value")) for n, d in parts.items()]
    return reduce(DataFrame.unionByName, rows).agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in parts]
    )


def targets(spark: SparkSession, root: str) -> DataFrame:
    d = inputs.datasets(spark, root)
    return d.select("dataset_id", F.lit(24).alias("target_hours"), (60.0 + F.col("dataset_no") * 3).alias("target_quality"))


def sla(spark: SparkSession, root: str) -> DataFrame:
    return governance.sla_compliance(
        inputs.datasets(spark, root), inputs.versions(spark, root), reports.reports(spark, root), inputs.AS_OF, targets(spark, root)
    )


def freshness(spark: SparkSession, root: str) -> DataFrame:
    log = governance.freshness_log(inputs.refreshes(spark, root))
    return governance.freshness_metrics(log, inputs.datasets(spark, root).select("dataset_id", "dataset_no"))


def policy_mappings(spark: SparkSession, root: str) -> DataFrame:
    """Every policy but the one with the dataset's own number; none for dataset 5."""
    each = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(c).alias("category")) for i, c in enumerate(POLICIES)]))
    d = inputs.datasets(spark, root).where("dataset_no <> 5").withColumn("p", each)
    return d.where("p.k <> dataset_no").select("dataset_id", F.concat(F.lit("P"), "p.k").alias("policy_id"), "p.category")


def sensitivity(spark: SparkSession, root: str) -> DataFrame:
    return schema.sensitivity(schema.semantic_catalog(contracting.schema_facts(spark, root)))


def compliance(spark: SparkSession, root: str) -> DataFrame:
    def build():
        return governance.compliance(
            policy_mappings(spark, root), inputs.datasets(spark, root), sensitivity(spark, root), inputs.versions(spark, root),
            freshness(spark, root), contracting.contract_violations(spark, root), reports.reports(spark, root),
        )

    return fact_table(spark, root, "compliance", build)


def platform(spark: SparkSession, root: str) -> DataFrame:
    def build():
        facts = governance.reliability_facts(
            inputs.datasets(spark, root), reports.reports(spark, root), sla(spark, root),
            governance.freshness_log(inputs.refreshes(spark, root)), inputs.incidents(spark, root),
        )
        return governance.platform_reliability(facts)

    return fact_table(spark, root, "platform", build)


def intelligence(spark: SparkSession, root: str) -> DataFrame:
    runs = table(spark, root, "events").agg(
        F.coalesce(F.try_divide(F.count_if(F.col("event_type") != "error") * 100.0, F.count(F.lit(1))), F.lit(100.0))
    )
    mean = lambda df, c: df.agg(F.coalesce(F.avg(c), F.lit(100.0)))
    parts = one_row(
        {
            "reliability": platform(spark, root).where("dataset_id = 'ALL'").select("platform_score"),
            "sla_compliance": mean(sla(spark, root), "compliance_pct"),
            "governance_compliance": mean(compliance(spark, root), "compliance_score"),
            "incident_stability": inputs.incidents(spark, root).where("status = 'OPEN'").agg(governance.fault_score(F.count(F.lit(1)))),
            "contract_compliance": contracting.contract_violations(spark, root).agg(governance.fault_score(F.count(F.lit(1)))),
            "workflow_success_rate": runs,
        }
    )
    return governance.intelligence_score(parts)


def open_by_version(spark: SparkSession, root: str) -> DataFrame:
    """Open incidents per version, of any severity."""
    i = inputs.incidents(spark, root).where("status = 'OPEN'")
    counts = i.groupBy("dataset_no", "version_number").agg(F.count(F.lit(1)).alias("open_count"))
    return counts.join(inputs.datasets(spark, root), "dataset_no").select("dataset_id", "version_number", "open_count")


def totals(spark: SparkSession, root: str) -> DataFrame:
    return reports.reports(spark, root).select(*KEYS, "column_count")


def root_causes(spark: SparkSession, root: str) -> DataFrame:
    t = totals(spark, root)
    iqr = reports.anomaly_facts(spark, root).withColumn("anomaly_type", F.lit("IQR"))
    return reduce(
        DataFrame.unionByName,
        [
            insight.quality_causes(reports.violation_facts(spark, root), t),
            insight.anomaly_causes(iqr, t),
            insight.drift_causes(reports.drift_facts(spark, root), t),
        ],
    )


def recommendations(spark: SparkSession, root: str) -> DataFrame:
    return insight.recommendations(
        reports.violation_facts(spark, root), reports.anomaly_facts(spark, root), reports.drift_facts(spark, root)
    )


def leaderboards(spark: SparkSession, root: str) -> DataFrame:
    return trends.leaderboard(trends.leaderboard_scores(reports.reports(spark, root), reports.scorecards(spark, root)))


def end_to_end(spark: SparkSession, root: str) -> DataFrame:
    """All reports of one run, one row per dataset version."""
    r = reports.scorecards(spark, root).select(*KEYS, "health_score", "reliability_score", "classification")
    count = lambda df, name: df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias(name))
    changes = schema.schema_changes(contracting.schema_facts(spark, root))
    pairs = schema.previous_versions(r).where("previous_version IS NOT NULL").select(
        "dataset_id", F.col("previous_version").alias("source_version"), F.col("version_number").alias("target_version")
    )
    full = reports.reports(spark, root)
    deltas = schema.version_deltas(full, full, pairs).select(
        "dataset_id", F.col("target_version").alias("version_number"), "row_delta", "health_delta"
    )
    parts = [
        count(changes, "schema_changes"),
        count(root_causes(spark, root), "root_causes"),
        count(recommendations(spark, root), "recommendations"),
        count(insight.incident_triggers(full, reports.violation_facts(spark, root)), "incidents"),
        deltas,
    ]
    out = reduce(lambda a, b: a.join(b, KEYS, "left"), parts, r)
    overall = leaderboards(spark, root).where("category = 'best_overall'").select("dataset_id", F.col("rank").alias("overall_rank"))
    out = (
        out.join(sensitivity(spark, root).select("dataset_id", "sensitivity_level"), "dataset_id", "left")
        .join(sla(spark, root).select("dataset_id", "compliance_pct"), "dataset_id", "left")
        .join(overall, "dataset_id", "left")
    )
    return out.na.fill(0, ["schema_changes", "root_causes", "recommendations", "incidents", "row_delta"]).na.fill(0.0, ["health_delta"])


