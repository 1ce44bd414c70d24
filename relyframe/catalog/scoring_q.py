"""N: scores, SLA, governance, incidents and insight."""

from pyspark.sql import functions as F

from relyframe.catalog.registry import query, r4
from relyframe.functions import scores
from relyframe.plans import governance, insight, platform, reports, trends
from relyframe.session import scratch
from relyframe.sources import inputs, sinks
from relyframe.sources.tables import table

K = inputs.KEYS

_PEN = ["null_penalty", "duplicate_penalty", "violation_penalty", "anomaly_penalty"]


def _rounded(cols):
    return ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in cols)


@query("n01_health_score", f"SELECT dataset_id, version_number, {_rounded(_PEN)}, round(health_score, 4) AS health_score, status FROM reports_v")
def health_score(spark, root):
    return r4(reports.reports(spark, root).select(*K, *_PEN, "health_score", "status"))


@query("n02_sub_scores", f"SELECT dataset_id, version_number, {_rounded(['quality_score', 'anomaly_score', 'drift_score'])} FROM reports_v")
def sub_scores(spark, root):
    return r4(reports.reports(spark, root).select(*K, "quality_score", "anomaly_score", "drift_score"))


@query(
    "n03_validation_report",
    f"""SELECT dataset_id, version_number, row_count, column_count, duplicate_rows_count, missing_cells_count, violation_count, anomaly_count,
       {_rounded(['missing_cells_percent', 'duplicate_rows_percent', 'overall_drift_score', 'health_score', 'quality_score', 'anomaly_score', 'drift_score'])},
       status, CAST(created_at AS VARCHAR) AS created_at FROM reports_v""",
)
def validation_report(spark, root):
    """Profile, rules, outliers and drift of every version, scored in one table."""
    return r4(
        reports.reports(spark, root).select(
            *K, "row_count", "column_count", "duplicate_rows_count", "missing_cells_count", "violation_count", "anomaly_count",
            "missing_cells_percent", "duplicate_rows_percent", "overall_drift_score", "health_score", "quality_score",
            "anomaly_score", "drift_score", "status", "created_at",
        )
    )


@query("n04_reliability_scorecard", "SELECT dataset_id, version_number, round(reliability_score, 4) AS reliability_score, classification FROM scorecards_v")
def reliability_scorecard(spark, root):
    return r4(reports.scorecards(spark, root).select(*K, "reliability_score", "classification"))


@query("n05_sla_compliance", "SELECT dataset_id, freshness_met, quality_met, round(compliance_pct, 4) AS compliance_pct FROM sla_v")
def sla_compliance(spark, root):
    return r4(platform.sla(spark, root))


@query("n06_freshness_log", "SELECT record_id, dataset_no, delay_minutes, status, CAST(expected_time AS VARCHAR) AS expected_time FROM freshness_v")
def freshness_log(spark, root):
    log = governance.freshness_log(inputs.refreshes(spark, root))
    return r4(log.select("record_id", "dataset_no", "delay_minutes", "status", "expected_time"))


@query("n07_freshness_metrics", "SELECT dataset_id, round(freshness_score, 4) AS freshness_score, sla_breach, round(average_delay_minutes, 4) AS average_delay_minutes FROM fresh_metrics_v")
def freshness_metrics(spark, root):
    return r4(platform.freshness(spark, root).select("dataset_id", "freshness_score", "sla_breach", "average_delay_minutes"))


@query("n08_governance_compliance", "SELECT dataset_id, round(compliance_score, 4) AS compliance_score, failed_policies, passed_policies FROM compliance_v")
def governance_compliance(spark, root):
    return r4(platform.compliance(spark, root))


_PLAT = ["quality_avg", "health_avg", "drift_avg", "anomaly_avg", "sla_compliance", "freshness_score", "stability", "platform_score"]


@query("n09_platform_reliability", f"SELECT dataset_id, datasets_monitored, active_incidents, critical_incidents, {_rounded(_PLAT)} FROM platform_v")
def platform_reliability(spark, root):
    """Overall and per dataset from one rollup of per-dataset sums."""
    return r4(platform.platform(spark, root).select("dataset_id", "datasets_monitored", "active_incidents", "critical_incidents", *_PLAT))


_INT = ["reliability", "sla_compliance", "governance_compliance", "incident_stability", "contract_compliance", "workflow_success_rate", "score"]


@query("n10_intelligence_score", f"SELECT {_rounded(_INT)}, rating FROM intelligence_v")
def intelligence_score(spark, root):
    return r4(platform.intelligence(spark, root).select(*_INT, "rating"))


@query(
    "n11_executive_scorecard",
    """SELECT (SELECT round(avg(reliability_score), 2) FROM scorecards_v) AS overall_platform_score, (SELECT count(*) FROM dataset_dim) AS datasets_monitored,
       (SELECT count(*) FROM incidents_v WHERE status = 'OPEN' AND severity IN ('critical', 'high')) AS critical_incidents,
       (SELECT round(avg(compliance_pct), 2) FROM sla_v) AS sla_compliance,
       (SELECT string_agg(dataset_id || ' v' || version_number || ' ' || classification, '; ' ORDER BY reliability_score, dataset_id, version_number)
        FROM (SELECT * FROM scorecards_v ORDER BY reliability_score, dataset_id, version_number LIMIT 5)) AS top_risks""",
)
def executive_scorecard(spark, root):
    cards = reports.scorecards(spark, root)
    i = inputs.incidents(spark, root).where((F.col("status") == "OPEN") & F.col("severity").isin("critical", "high"))
    row = platform.one_row(
        {
            "overall_platform_score": cards.agg(F.coalesce(F.round(F.avg("reliability_score"), 2), F.lit(100.0))),
            "datasets_monitored": inputs.datasets(spark, root).agg(F.count(F.lit(1))),
            "critical_incidents": i.agg(F.count(F.lit(1))),
            "sla_compliance": platform.sla(spark, root).agg(F.coalesce(F.round(F.avg("compliance_pct"), 2), F.lit(100.0))),
        }
    )
    low = cards.orderBy("reliability_score", *K).limit(5)
    risks = low.agg(F.sort_array(F.collect_list(F.struct("reliability_score", *K, "classification"))).alias("a")).select(
        F.array_join(
            F.transform("a", lambda x: F.concat(x["dataset_id"], F.lit(" v"), x["version_number"], F.lit(" "), x["classification"])), "; "
        ).alias("top_risks")
    )
    # Two frames of exactly one row each.
    both = row.withColumn("_j", F.lit(1)).join(risks.withColumn("_j", F.lit(1)), "_j").drop("_j")
    return both.withColumn("datasets_monitored", F.col("datasets_monitored").cast("bigint")).withColumn(
        "critical_incidents", F.col("critical_incidents").cast("bigint")
    )


@query(
    "n12_report_quality",
    "SELECT round(0.35 * 95.0 + 0.25 * incident_stability + 0.20 * sla_compliance + 0.20 * 90.0, 4) AS report_quality_score FROM intelligence_v",
)
def report_quality(spark, root):
    s = platform.intelligence(spark, root)
    return r4(s.select(governance.report_quality(F.col("incident_stability"), F.col("sla_compliance")).alias("report_quality_score")))


@query(
    "n13_certification",
    """SELECT dataset_id, CASE WHEN health >= 90 AND quality >= 90 AND drift <= 0.2 AND sla = 100 AND o = 0 THEN 'platinum' WHEN health >= 80 AND quality >= 80 AND drift <= 0.3 AND sla >= 90 AND o = 0 THEN 'gold'
              WHEN health >= 65 AND quality >= 65 AND drift <= 0.5 AND o <= 1 THEN 'silver' ELSE 'bronze' END AS certification_level,
              CAST(TIMESTAMP '2024-02-01' + INTERVAL 90 DAY AS VARCHAR) AS expires_at, printf('health=%.1f, quality=%.1f, SLA=%.1f%%, incidents=%d', health, quality, sla, o) AS notes
       FROM (SELECT n.dataset_id, n.health_score AS health, n.quality_score AS quality, n.overall_drift_score AS drift, s.compliance_pct AS sla, coalesce(i.c, 0) AS o
             FROM newest_v n JOIN sla_v s USING (dataset_id) JOIN dataset_dim d USING (dataset_id)
             LEFT JOIN (SELECT dataset_no, version_number, count(*) AS c FROM incidents_v WHERE status = 'OPEN' GROUP BY ALL) i
               ON i.dataset_no = d.dataset_no AND i.version_number = n.version_number)""",
)
def certification(spark, root):
    return r4(
        governance.certification(
            inputs.datasets(spark, root), inputs.versions(spark, root), reports.reports(spark, root), platform.sla(spark, root),
            platform.open_by_version(spark, root), inputs.AS_OF,
        )
    )


@query("n14_leaderboards", "SELECT category, dataset_id, round(score, 4) + 0.0 AS score, rank FROM boards_v")
def leaderboards(spark, root):
    return r4(platform.leaderboards(spark, root))


@query(
    "n15_trend_forecasts",
    """SELECT dataset_id, metric, round(greatest(0, least(100, regr_intercept(v, x) + regr_slope(v, x) * count(*))), 4) AS regression_forecast, round(avg(v) FILTER (WHERE r <= 3), 4) AS moving_average_forecast
       FROM (SELECT *, (row_number() OVER (PARTITION BY dataset_id, metric ORDER BY version_number) - 1)::DOUBLE AS x, row_number() OVER (PARTITION BY dataset_id, metric ORDER BY version_number DESC) AS r FROM
         (SELECT dataset_id, version_number, unnest(['health_score', 'quality_score', 'anomaly_score', 'drift_score']) AS metric,
                 unnest([health_score, quality_score, anomaly_score, drift_score]) AS v FROM reports_v)) GROUP BY ALL""",
)
def trend_forecasts(spark, root):
    s, by = trends.score_series(reports.reports(spark, root)), ["dataset_id", "metric"]
    line = trends.forecast(s, by, "version_number", "value").select(*by, F.col("forecast").alias("regression_forecast"))
    mean = trends.moving_average(s, by, "version_number", "value").select(*by, F.col("moving_average").alias("moving_average_forecast"))
    return r4(line.join(mean, by))


def _cause(name, issue):
    def run(spark, root):
        t = platform.totals(spark, root)
        if issue == "quality":
            df = insight.quality_causes(reports.violation_facts(spark, root), t)
        elif issue == "anomaly":
            df = insight.anomaly_causes(reports.anomaly_facts(spark, root).withColumn("anomaly_type", F.lit("IQR")), t)
        else:
            df = insight.drift_causes(reports.drift_facts(spark, root), t)
        return r4(df)

    run.__doc__ = f"Root cause of the {issue} findings of each version."
    query(name, f"SELECT dataset_id, version_number, issue_type, root_cause, round(confidence, 4) AS confidence, finding_count FROM causes_v WHERE issue_type = '{issue}'")(run)


_cause("n16_root_cause_quality", "quality")
_cause("n17_root_cause_anomaly", "anomaly")
_cause("n18_root_cause_drift", "drift")


@query("n19_recommendations", "SELECT * FROM recs_v")
def recommendations(spark, root):
    return platform.recommendations(spark, root)


@query(
    "n20_recommendation_priority",
    """SELECT dataset_id, version_number, title, priority, round(0.4 * CASE priority WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5 ELSE 0.2 END + 0.3 * 0.8 + 0.2 * 0.7 + 0.1 * 0.5, 4)::DOUBLE AS priority_score FROM recs_v""",
)
def recommendation_priority(spark, root):
    r = platform.recommendations(spark, root)
    return r4(r.select(*K, "title", "priority", insight.priority_score(F.col("priority")).alias("priority_score")))


@query(
    "n21_recommendation_outcome",
    """SELECT dataset_id, version_number, round(CASE WHEN b > 0 THEN (a - b) / b * 100 ELSE 0 END, 4) + 0.0 AS improvement_pct, round((a - b) / CASE WHEN version_number % 4 = 0 THEN 1 ELSE version_number % 4 END, 4) + 0.0 AS roi_score
       FROM (SELECT dataset_id, version_number, health_score AS a, lag(health_score) OVER (PARTITION BY dataset_id ORDER BY version_number) AS b FROM reports_v) WHERE b IS NOT NULL""",
)
def recommendation_outcome(spark, root):
    """Health before and after each new version; the cost factor comes with the version."""
    r = reports.reports(spark, root).select(*K, F.col("health_score").alias("after_score"))
    before = r.select("dataset_id", (F.col("version_number") + 1).alias("version_number"), F.col("after_score").alias("before_score"))
    df = r.join(before, K).withColumn("cost_factor", F.col("version_number") % 4)
    return r4(insight.outcomes(df).select(*K, "improvement_pct", "roi_score"))


@query("n22_incident_triggers", "SELECT * FROM triggers_v")
def incident_triggers(spark, root):
    return insight.incident_triggers(reports.reports(spark, root), reports.violation_facts(spark, root))


MONITOR_RULES = [
    (1, "health_score", "<", 60.0),
    (2, "quality_score", "<=", 75.0),
    (3, "drift_score", ">", 76.0),
    (4, "anomaly_count", "==", 100.0),
    (5, "freshness_delay", ">=", 1.0),
    (6, "freshness_delay", "~", 0.0),
]


@query(
    "n23_monitoring_alerts",
    """SELECT dataset_id, version_number, rule_id, metric, 'OPEN' AS status, printf('Metric ''%s'' breached threshold %s %.2f. Actual value: %.2f.', metric, op, threshold, value) AS message FROM
       (SELECT r.dataset_id, version_number, unnest(['health_score', 'quality_score', 'drift_score', 'anomaly_count', 'freshness_delay']) AS metric,
               unnest([health_score, quality_score, drift_score, anomaly_score, latest_delay::DOUBLE]) AS value FROM reports_v r LEFT JOIN fresh_metrics_v USING (dataset_id))
       JOIN (VALUES (1, 'health_score', '<', 60.0::DOUBLE), (2, 'quality_score', '<=', 75.0), (3, 'drift_score', '>', 76.0), (4, 'anomaly_count', '==', 100.0), (5, 'freshness_delay', '>=', 1.0), (6, 'freshness_delay', '~', 0.0)) m(rule_id, metric, op, threshold) USING (metric)
       WHERE CASE op WHEN '<' THEN value < threshold WHEN '<=' THEN value <= threshold WHEN '>' THEN value > threshold WHEN '>=' THEN value >= threshold WHEN '==' THEN value = threshold ELSE false END""",
)
def monitoring_alerts(spark, root):
    """The metric named anomaly_count reads the anomaly score."""
    f = platform.freshness(spark, root).select("dataset_id", F.col("latest_delay").cast("double").alias("freshness_delay"))
    names = ["health_score", "quality_score", "drift_score", "anomaly_count", "freshness_delay"]
    r = reports.reports(spark, root).select(*K, "health_score", "quality_score", "drift_score", F.col("anomaly_score").alias("anomaly_count"))
    long = r.join(f, "dataset_id", "left").unpivot(K, names, "metric", "value")
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("rule_id", "metric", "op", "threshold"), x)]) for x in MONITOR_RULES]))
    rules = inputs.datasets(spark, root).select("dataset_id", each.alias("r")).select("dataset_id", "r.*")
    return insight.monitoring_alerts(long, rules)


@query(
    "n24_investigation_sla",
    """SELECT incident_id, severity AS priority, CASE severity WHEN 'critical' THEN 12 WHEN 'low' THEN 48 ELSE 24 END AS target_hours, CAST(user_id % 60 AS INTEGER) AS actual_hours,
              user_id % 60 > CASE severity WHEN 'critical' THEN 12 WHEN 'low' THEN 48 ELSE 24 END AS breached FROM incidents_v""",
)
def investigation_sla(spark, root):
    """Each incident is resolved after user_id mod 60 hours and 30 minutes."""
    took = F.make_dt_interval(hours=(F.col("user_id") % 60).cast("int"), mins=F.lit(30))
    i = inputs.incidents(spark, root).select("incident_id", F.col("severity").alias("priority"), "created_at", (F.col("created_at") + took).alias("resolved_at"))
    return insight.investigation_sla(i).select("incident_id", "priority", "target_hours", "actual_hours", "breached")


@query(
    "n25_evidence_confidence",
    """SELECT v.dataset_id, v.version_number, coalesce(n, 0) AS evidence_count, round(CASE WHEN n IS NULL THEN 0.0 ELSE greatest(0, least(100, (0.4 * least(1.0, n / 3.0::DOUBLE) + 0.3 * w + 0.2 * 0.8 + 0.1 * 0.9) * 100)) END, 4)::DOUBLE AS confidence_score,
              CASE WHEN n IS NULL THEN 'REVIEW_REQUIRED' ELSE 'COMPLETED' END AS status
       FROM versions_v v LEFT JOIN (SELECT dataset_id, version_number, count(*) AS n, avg(w)::DOUBLE AS w FROM (
           SELECT dataset_id, version_number, 0.9::DOUBLE AS w FROM violations_v WHERE severity = 'critical' UNION ALL
           SELECT dataset_id, version_number, 0.8 FROM drift_v WHERE severity = 'HIGH' AND drift_metric = 'PSI' UNION ALL
           SELECT dataset_id, version_number, 0.5 FROM outliers_v WHERE outlier_count > 6) GROUP BY ALL) e USING (dataset_id, version_number)""",
)
def evidence_confidence(spark, root):
    key = F.concat_ws("/", *K).alias("analysis_id")
    parts = [
        ("violation", reports.violation_facts(spark, root).where("severity = 'critical'")),
        ("drift", reports.drift_facts(spark, root).where("severity = 'HIGH' AND drift_metric = 'PSI'")),
        ("other", reports.anomaly_facts(spark, root).where("anomaly_count > 6")),
    ]
    ev = None
    for kind, df in parts:
        one = df.select(key, F.lit(kind).alias("evidence_type"))
        ev = one if ev is None else ev.unionByName(one)
    analyses = inputs.versions(spark, root).select(key, *K)
    return r4(insight.evidence_confidence(analyses, ev).drop("analysis_id"))


@query(
    "n26_incident_summaries",
    r"""SELECT incident_id, response, sha256(prompt) AS input_hash, sha256(response) AS output_hash,
              CAST(len(regexp_extract_all(prompt, '\S+')) + len(regexp_extract_all(response, '\S+')) AS INTEGER) AS token_estimate FROM
       (SELECT incident_id, 'Explain incident ''' || t || ''' (severity: ' || severity || ') with description: ' || d || '.' AS prompt,
               'Incident ''' || t || ''' of severity ''' || severity || ''' occurred. Description: ' || d || '.' AS response
        FROM (SELECT *, 'Error event ' || incident_id AS t, printf('value %.2f for user %d', value, user_id) AS d FROM incidents_v))""",
)
def incident_summaries(spark, root):
    i = inputs.incidents(spark, root)
    fields = {
        "incident_title": F.concat(F.lit("Error event "), "incident_id"),
        "severity": F.col("severity"),
        "description": F.format_string("value %.2f for user %d", "value", "user_id"),
    }
    t = insight.summary_texts(
        i, insight.fill_template(insight.INCIDENT_PROMPT, **fields), insight.fill_template(insight.INCIDENT_TEXT, **fields)
    )
    return t.select("incident_id", "response", "input_hash", "output_hash", "token_estimate")


@query(
    "n26_dataset_summaries",
    r"""SELECT dataset_id, prompt, response, sha256(prompt) AS input_hash, sha256(response) AS output_hash,
              CAST(len(regexp_extract_all(prompt, '\S+')) + len(regexp_extract_all(response, '\S+')) AS INTEGER) AS token_estimate FROM
       (SELECT dataset_id, 'Summarize health status for dataset ID: ' || dataset_id || '.' AS prompt, 'Dataset ' || dataset_id || ' is monitored. Health score is stable.' AS response FROM dataset_dim)""",
)
def dataset_summaries(spark, root):
    d, key = inputs.datasets(spark, root).select("dataset_id"), F.col("dataset_id")
    return insight.summary_texts(
        d, insight.fill_template(insight.DATASET_PROMPT, dataset_id=key), insight.fill_template(insight.DATASET_TEXT, dataset_id=key)
    )


@query(
    "n27_cost_by_resource",
    "SELECT event_type AS resource_type, user_id AS resource_id, round(sum(value), 4) AS cpu_ms, round(sum(value) * 0.0001::DOUBLE, 4) AS estimated_cost FROM events GROUP BY ALL",
)
def cost_by_resource(spark, root):
    e = table(spark, root, "events").groupBy(F.col("event_type").alias("resource_type"), F.col("user_id").alias("resource_id"))
    return r4(e.agg(F.sum("value").alias("cpu_ms"), (F.sum("value") * scores.CPU_MS_PRICE).alias("estimated_cost")))


@query(
    "n28_retention_purge",
    """SELECT dataset_id, count(*) FILTER (WHERE old) AS purged_count, count(*) FILTER (WHERE NOT old) AS survivors FROM
       (SELECT o_orderpriority AS dataset_id, o_orderdate < TIMESTAMP '2001-08-01' - to_days(CAST(CASE WHEN substr(o_orderpriority, 1, 1) = '5' THEN 30 ELSE 365 * substr(o_orderpriority, 1, 1)::INTEGER END AS INTEGER)) AS old FROM orders) GROUP BY 1""",
)
def retention_purge(spark, root):
    policies = inputs.datasets(spark, root).where("dataset_no <> 5").select("dataset_id", (F.col("dataset_no") * 365).alias("retention_days"))
    rows = table(spark, root, "orders").select(F.col("o_orderpriority").alias("dataset_id"), F.col("o_orderdate").alias("created_at"))
    path, shape = scratch(spark, "retention"), "created_at timestamp_ntz, dataset_id string"
    sinks.replace_by_key(rows, path, ["dataset_id"])
    purged = insight.purge_table(path, shape, policies, "2001-08-01 00:00:00")
    left = spark.read.schema(shape).parquet(path).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("survivors"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("dataset_id").distinct().join(purged, "dataset_id", "left").join(left, "dataset_id", "left").select("dataset_id", zero("purged_count"), zero("survivors"))


@query(
    "n29_quality_summary",
    """SELECT count(*) AS total_executions, count(*) FILTER (WHERE violation_count = 0) AS clean_executions, count(*) FILTER (WHERE violation_count > 0) AS failed_executions,
              CAST(sum(violation_count) AS BIGINT) AS total_violations, round(avg(health_score), 2) AS average_health_score, round(avg(quality_score), 2) AS average_quality_score FROM reports_v""",
)
def quality_summary(spark, root):
    v = F.col("violation_count")
    return reports.reports(spark, root).agg(
        F.count(F.lit(1)).alias("total_executions"),
        F.count_if(v == 0).alias("clean_executions"),
        F.count_if(v > 0).alias("failed_executions"),
        F.sum(v).alias("total_violations"),
        F.coalesce(F.round(F.avg("health_score"), 2), F.lit(100.0)).alias("average_health_score"),
        F.coalesce(F.round(F.avg("quality_score"), 2), F.lit(100.0)).alias("average_quality_score"),
    )


_DIFF = """(SELECT version_number, dataset_id, count(*) AS c FROM (
   SELECT coalesce(n.dataset_id, o.dataset_id) AS dataset_id, coalesce(n.version_number, o.version_number) AS version_number, o.data_type AS a, n.data_type AS b
   FROM (SELECT * FROM schema_rows WHERE version_number > 1) n
   FULL JOIN (SELECT dataset_id, version_number + 1 AS version_number, column_name, data_type FROM schema_rows WHERE version_number < 7) o
     ON n.dataset_id = o.dataset_id AND n.version_number = o.version_number AND n.column_name = o.column_name) WHERE a IS DISTINCT FROM b GROUP BY ALL)"""


@query(
    "n30_end_to_end",
    f"""SELECT s.dataset_id, s.version_number, round(s.health_score, 4) AS health_score, round(reliability_score, 4) AS reliability_score, classification,
       coalesce(x.c, 0) AS schema_changes, coalesce(ca.c, 0) AS root_causes, coalesce(re.c, 0) AS recommendations, coalesce(tr.c, 0) AS incidents,
       coalesce(s.row_count - p.row_count, 0) AS row_delta, round(coalesce(s.health_score - p.health_score, 0), 4) + 0.0 AS health_delta,
       se.sensitivity_level, round(sl.compliance_pct, 4) AS compliance_pct, b.rank AS overall_rank
     FROM scorecards_v s LEFT JOIN {_DIFF} x USING (dataset_id, version_number)
     LEFT JOIN (SELECT dataset_id, version_number, count(*) AS c FROM causes_v GROUP BY ALL) ca USING (dataset_id, version_number)
     LEFT JOIN (SELECT dataset_id, version_number, count(*) AS c FROM recs_v GROUP BY ALL) re USING (dataset_id, version_number)
     LEFT JOIN (SELECT dataset_id, version_number, count(*) AS c FROM triggers_v GROUP BY ALL) tr USING (dataset_id, version_number)
     LEFT JOIN reports_v p ON p.dataset_id = s.dataset_id AND p.version_number = s.version_number - 1
     LEFT JOIN sensitivity_v se ON se.dataset_id = s.dataset_id LEFT JOIN sla_v sl ON sl.dataset_id = s.dataset_id
     LEFT JOIN (SELECT dataset_id, rank FROM boards_v WHERE category = 'best_overall') b ON b.dataset_id = s.dataset_id""",
)
def end_to_end(spark, root):
    return r4(platform.end_to_end(spark, root))
