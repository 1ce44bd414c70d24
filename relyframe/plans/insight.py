"""Root causes, recommendations, incidents, alerts, summaries, costs, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relyframe.functions import scores
from relyframe.operators import relational
from relyframe.operators.keyed import match
from relyframe.session import settle
from relyframe.sources import sinks
from relyframe.sources.inputs import KEYS

# Weights and labels of the root-cause and summary reports.
SEVERITY_WEIGHTS = {"low": 1.0, "medium": 2.0, "high": 3.0, "critical": 4.0}
DRIFT_WEIGHTS = {"LOW": 1.0, "MEDIUM": 2.5, "HIGH": 4.0}
MESSAGE_CAUSES = [
    (["NULL", "MISSING"], "missing_data"),
    (["DUPLICATE"], "duplicate_records"),
    (["REGEX", "FORMAT"], "schema_violations"),
    (["MIN", "MAX"], "range_failures"),
    (["REFERENTIAL"], "referential_breaks"),
]
DRIFT_CAUSES = {
    "PSI": "distribution_shift",
    "DIST_DRIFT": "distribution_shift",
    "MEAN_SHIFT": "mean_shift",
    "STD_SHIFT": "variance_shift",
    "CARD_DRIFT": "cardinality_shift",
}
INCIDENT_PROMPT = "Explain incident '{incident_title}' (severity: {severity}) with description: {description}."
INCIDENT_TEXT = "Incident '{incident_title}' of severity '{severity}' occurred. Description: {description}."
DATASET_PROMPT = "Summarize health status for dataset ID: {dataset_id}."
DATASET_TEXT = "Dataset {dataset_id} is monitored. Health score is stable."
QUALITY_TITLE, ANOMALY_TITLE, DRIFT_TITLE = (
    "Resolve Quality Failure in ",
    "Investigate Outliers in Column ",
    "Review Drift in Column ",
)
# Why a recommendation is made, its evidence, and how both are written down.
QUALITY_WHY = "This recommendation was generated because the quality check failed."
QUALITY_EVIDENCE = "Rule failed on column '%s'. Actual value: %s. Expected threshold: %s."
ANOMALY_WHY = "Generated due to a high density of outlier points detected in '%s'."
DRIFT_WHY = "Generated due to significant data drift detected compared to baseline."
DESCRIPTION = "Title: %s\nWhy: %s\nEvidence: %s"
ANOMALY_EVIDENCE = "Detected %d anomaly points using algorithm %s."
DRIFT_EVIDENCE = "Metric '%s' score is %.4f (Severity: %s)."
LOW_HEALTH = ("Critical Dataset Health Score Breach", "Dataset health score dropped to %.2f, breaching the threshold limit.")
BAD_RULES = (
    "Critical Quality Validation Violations",
    "Detected %d critical validation checks failing in quality execution run.",
)
MANY_OUTLIERS = (
    "Excessive Outliers Detected",
    "Outlier validation run detected a high density of %d anomalous points.",
)
ALERT_TEXT = "Metric '%s' breached threshold %s %.2f. Actual value: %.2f."
EVIDENCE_NEEDED = 3
INVESTIGATION_HOURS = {"critical": 12, "low": 48}
RETENTION_DAYS = 30


def label(x: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(x == k, F.lit(v)).otherwise(out)
    return out


def confidence(affected: Column, total: Column, weight: Column) -> Column:
    share = affected / F.greatest(total, F.lit(1)) * 0.5
    return F.least(share + weight / 4.0 * 0.5, F.lit(1.0))


def message_cause(message: Column) -> Column:
    up = F.upper(message)
    out = F.lit("schema_violations")
    for words, cause in reversed(MESSAGE_CAUSES):
        hit = up.contains(words[0])
        for w in words[1:]:
            hit = hit | up.contains(w)
        out = F.when(hit, cause).otherwise(out)
    return out


def quality_causes(violations: DataFrame, totals: DataFrame) -> DataFrame:
    v = violations.withColumn("root_cause", message_cause(F.col("message")))
    facts = v.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.count_distinct(F.nullif("column_name", F.lit(""))).alias("affected"),
        F.max(scores.lookup(F.col("severity"), SEVERITY_WEIGHTS, 1.0)).alias("weight"),
    )
    top = relational.most_common(v, KEYS, "root_cause").select(*KEYS, "root_cause")
    return facts.join(top, KEYS).join(totals, KEYS).select(
        *KEYS,
        F.lit("quality").alias("issue_type"),
        "root_cause",
        confidence(F.col("affected"), F.col("column_count"), F.col("weight")).alias("confidence"),
        "finding_count",
    )


def anomaly_causes(anomalies: DataFrame, totals: DataFrame) -> DataFrame:
    """``anomalies``: one row per version, column and detector with a count."""
    kind = F.lower("anomaly_type")
    facts = anomalies.where("anomaly_count > 0").groupBy(*KEYS).agg(
        F.sum("anomaly_count").alias("finding_count"),
        F.count_distinct("column_name").alias("affected"),
        F.bool_or(kind == "isolation_forest").alias("forest"),
        F.bool_or(kind == "local_outlier_factor").alias("density"),
    )
    cause = F.when(F.col("forest"), "multivariate_outlier").when(F.col("density"), "density_outlier").otherwise("single_column_outlier")
    return facts.join(totals, KEYS).select(
        *KEYS,
        F.lit("anomaly").alias("issue_type"),
        cause.alias("root_cause"),
        confidence(F.col("affected"), F.col("column_count"), F.lit(4.0)).alias("confidence"),
        "finding_count",
    )


def drift_causes(drifts: DataFrame, totals: DataFrame) -> DataFrame:
    d = drifts.where(F.col("severity").isin("MEDIUM", "HIGH")).withColumn(
        "root_cause", label(F.col("drift_metric"), DRIFT_CAUSES, "distribution_shift")
    )
    facts = d.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.count_distinct("column_name").alias("affected"),
        F.max(scores.lookup(F.col("severity"), DRIFT_WEIGHTS, 1.0)).alias("weight"),
    )
    top = relational.most_common(d, KEYS, "root_cause").select(*KEYS, "root_cause")
    return facts.join(top, KEYS).join(totals, KEYS).select(
        *KEYS,
        F.lit("drift").alias("issue_type"),
        "root_cause",
        confidence(F.col("affected"), F.col("column_count"), F.col("weight")).alias("confidence"),
        "finding_count",
    )


def recommendations(violations: DataFrame, anomalies: DataFrame, drifts: DataFrame, algorithm: str = "iqr") -> DataFrame:
    """What to look at, from the three kinds of findings, with the reason and a description.

    Figures in the evidence of failed rules have four decimals; a figure that
    could not be computed is written as None.
    """
    shape = [*KEYS, "recommendation_type", "priority", "title", "why", "evidence", "message"]
    figure = lambda c: F.when(F.col(c).isNull(), "None").otherwise(F.format_string("%.4f", c))
    fix = violations.where(F.col("severity").isin("high", "critical")).select(
        *KEYS,
        F.lit("QUALITY_REMEDIATION").alias("recommendation_type"),
        F.col("severity").alias("priority"),
        F.concat(F.lit(QUALITY_TITLE), F.coalesce("column_name", F.lit("dataset"))).alias("title"),
        F.lit(QUALITY_WHY).alias("why"),
        F.format_string(QUALITY_EVIDENCE, F.coalesce("column_name", F.lit("None")), figure("actual_value"), figure("expected_value")).alias("evidence"),
        F.col("message").alias("message"),
    )
    look = anomalies.where("anomaly_count > 0").select(
        *KEYS,
        F.lit("ANOMALY_INVESTIGATION").alias("recommendation_type"),
        F.when(F.col("anomaly_count") > 5, "high").otherwise("medium").alias("priority"),
        F.concat(F.lit(ANOMALY_TITLE), "column_name").alias("title"),
        F.format_string(ANOMALY_WHY, "column_name").alias("why"),
        F.format_string(ANOMALY_EVIDENCE, "anomaly_count", F.lit(algorithm)).alias("evidence"),
        F.lit(None).cast("string").alias("message"),
    )
    review = drifts.where(F.col("severity").isin("MEDIUM", "HIGH")).select(
        *KEYS,
        F.lit("DRIFT_REVIEW").alias("recommendation_type"),
        F.when(F.col("severity") == "HIGH", "high").otherwise("medium").alias("priority"),
        F.concat(F.lit(DRIFT_TITLE), "column_name").alias("title"),
        F.lit(DRIFT_WHY).alias("why"),
        F.format_string(DRIFT_EVIDENCE, "drift_metric", "drift_score", "severity").alias("evidence"),
        F.lit(None).cast("string").alias("message"),
    )
    found = fix.select(shape).unionByName(look.select(shape)).unionByName(review.select(shape))
    written = F.concat(F.format_string(DESCRIPTION, "title", "why", "evidence"), F.coalesce(F.concat(F.lit("\nMessage: "), "message"), F.lit("")))
    return found.withColumn("description", written).drop("message")


def priority_score(priority: Column) -> Column:
    """Severity weight mixed with fixed reliability, SLA and frequency impacts."""
    return scores.lookup(priority, scores.PRIORITY_WEIGHTS, 0.2) * 0.4 + F.lit(0.3 * 0.8 + 0.2 * 0.7 + 0.1 * 0.5)


def outcomes(df: DataFrame) -> DataFrame:
    """Improvement and return for before / after scores and a cost factor."""
    gain = F.col("after_score") - F.col("before_score")
    cost = F.coalesce(F.nullif("cost_factor", F.lit(0)), F.lit(1)).cast("double")
    return df.withColumn(
        "improvement_pct", F.when(F.col("before_score") > 0, gain / F.col("before_score") * 100.0).otherwise(0.0)
    ).withColumn("roi_score", gain / cost)


def incident_triggers(reports: DataFrame, violations: DataFrame) -> DataFrame:
    """Incidents raised by a low score, critical violations or many outliers."""
    shape = [*KEYS, "severity", "title", "description"]
    low = reports.where("health_score < 50").select(
        *KEYS,
        F.lit("critical").alias("severity"),
        F.lit(LOW_HEALTH[0]).alias("title"),
        F.format_string(LOW_HEALTH[1], "health_score").alias("description"),
    )
    bad = (
        violations.where("severity = 'critical'")
        .groupBy(*KEYS)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            *KEYS,
            F.lit("high").alias("severity"),
            F.lit(BAD_RULES[0]).alias("title"),
            F.format_string(BAD_RULES[1], "n").alias("description"),
        )
    )
    many = reports.where("anomaly_count > 10").select(
        *KEYS,
        F.lit("medium").alias("severity"),
        F.lit(MANY_OUTLIERS[0]).alias("title"),
        F.format_string(MANY_OUTLIERS[1], "anomaly_count").alias("description"),
    )
    return low.select(shape).unionByName(bad.select(shape)).unionByName(many.select(shape))


def monitoring_alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """``metrics``: keys, metric, value. ``rules``: dataset_id, rule_id, metric, op, threshold."""
    hit = relational.compare(F.col("value"), F.col("op"), F.col("threshold"))
    text = F.format_string(ALERT_TEXT, "metric", "op", "threshold", "value")
    return metrics.join(rules, ["dataset_id", "metric"]).where(hit).select(
        *KEYS, "rule_id", "metric", F.lit("OPEN").alias("status"), text.alias("message")
    )


def investigation_sla(df: DataFrame) -> DataFrame:
    """Target and used hours of investigations with priority, created_at, resolved_at."""
    target = F.lit(24)
    for p, h in INVESTIGATION_HOURS.items():
        target = F.when(F.col("priority") == p, h).otherwise(target)
    hours = F.expr("timestampdiff(HOUR, created_at, resolved_at)").cast("int")
    return df.withColumn("target_hours", target).withColumn("actual_hours", hours).withColumn(
        "breached", F.col("actual_hours") > F.col("target_hours")
    )


def evidence_confidence(analyses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Grounding score of each analysis; without evidence it has to be reviewed."""
    w = scores.lookup(F.col("evidence_type"), scores.EVIDENCE_WEIGHTS, 0.5)
    facts = evidence.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n"), F.avg(w).alias("source"))
    joined = analyses.join(facts, "analysis_id", "left")
    raw = (F.least(F.lit(1.0), F.col("n") / float(EVIDENCE_NEEDED)) * 0.4 + F.col("source") * 0.3 + 0.2 * 0.8 + 0.1 * 0.9) * 100.0
    return joined.select(
        *analyses.columns,
        F.coalesce("n", F.lit(0)).alias("evidence_count"),
        F.when(F.col("n").isNull(), F.lit(0.0)).otherwise(scores.clamp(raw)).alias("confidence_score"),
        F.when(F.col("n").isNull(), "REVIEW_REQUIRED").otherwise("COMPLETED").alias("status"),
    )


def fill_template(template: str, **fields: Column) -> Column:
    """Named placeholders of the template replaced by columns."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit(r"\S+"))


def summary_texts(df: DataFrame, prompt: Column, response: Column) -> DataFrame:
    df = df.withColumn("prompt", prompt).withColumn("response", response)
    return df.withColumns(
        {
            "input_hash": F.sha2("prompt", 256),
            "output_hash": F.sha2("response", 256),
            "token_estimate": word_count(F.col("prompt")) + word_count(F.col("response")),
        }
    )


def cost_rollup(compute: DataFrame, storage: DataFrame) -> DataFrame:
    """Both inputs shrink to one partial sum per task before they meet."""
    c = compute.select((F.col("cpu_ms") * scores.CPU_MS_PRICE).alias("compute"), F.lit(0.0).alias("storage"))
    s = storage.select(F.lit(0.0).alias("compute"), F.col("monthly_cost").alias("storage"))
    sums = c.unionByName(s).agg(F.sum("compute").alias("compute"), F.sum("storage").alias("storage"))
    return sums.withColumn("total", F.col("compute") + F.col("storage"))


def purge(rows: DataFrame, policies: DataFrame, as_of: str) -> DataFrame:
    """Marks rows older than their dataset's retention (30 days without a policy)."""
    days = F.coalesce("retention_days", F.lit(RETENTION_DAYS))
    limit = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=days)
    return rows.join(policies.select("dataset_id", "retention_days"), "dataset_id", "left").withColumn(
        "purged", F.col("created_at") < limit
    )


def purge_table(path: str, schema: str, policies: DataFrame, as_of: str) -> DataFrame:
    """Rewrites the datasets of a stored table (partitions by dataset_id) that hold rows past their retention; purged rows per dataset.

    Survivors are settled before their partitions are replaced. Partitions of
    which nothing survives are deleted.
    """
    spark = policies.sparkSession
    stored = spark.read.schema(schema).parquet(path)
    marked = purge(stored, policies, as_of)
    counts = settle(marked.groupBy("dataset_id").agg(F.count_if("purged").alias("purged_count")).where("purged_count > 0"))
    touched = match(marked, counts.select("dataset_id"), ["dataset_id"], "left_semi")
    left = settle(touched.where("NOT coalesce(purged, false)").select(*stored.columns))
    emptied = match(counts.select("dataset_id"), left.select("dataset_id").distinct(), ["dataset_id"], "left_anti")
    sinks.replace_by_key(left, path, ["dataset_id"])
    where = spark._jvm.org.apache.hadoop.fs.Path
    fs = where(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in emptied.toLocalIterator():  # one name per emptied dataset
        fs.delete(where(path, f"dataset_id={r.dataset_id}"), True)
    return counts


def rank_movement(boards: DataFrame) -> DataFrame:
    """``boards``: category, dataset_id, refresh, rank. The first refresh is flat."""
    before = F.lag("rank").over(Window.partitionBy("category", "dataset_id").orderBy("refresh"))
    rank, prev = F.col("rank"), F.col("_prev")
    return (
        boards.withColumn("_prev", before)
        .withColumn("previous_rank", F.coalesce(prev, rank))
        .withColumn("movement", F.when(rank < prev, "up").when(rank > prev, "down").otherwise("flat"))
        .drop("_prev")
    )
