"""K, L, M: anomalies, drift, comparison and schema evolution."""

from pyspark.sql import functions as F

from relyframe.catalog.registry import query, r4
from relyframe.operators import anomaly, detectors, drift, profile, schema
from relyframe.plans import contracting, reports
from relyframe.sources import inputs
from relyframe.sources.tables import table

K = inputs.KEYS


@query(
    "k01_zscore",
    """SELECT dataset_id, version_number, column_name, row_key AS o_orderkey, round(abs(value - mean) / std, 4) AS score, 'Z_SCORE' AS anomaly_type, round(value, 4) AS value,
              round(mean, 4) AS mean, round(std, 4) AS std FROM num_long JOIN fences_v USING (dataset_id, version_number, column_name)
       WHERE n > 2 AND std > 0 AND abs(value - mean) / std > 3.0""",
)
def zscore(spark, root):
    d = inputs.dirty_orders(spark, root)
    return r4(anomaly.zscore_anomalies(d, K, ["o_orderkey"]))


@query(
    "k02_iqr",
    """SELECT dataset_id, version_number, column_name, row_key AS o_orderkey, round(abs(value - median) / CASE WHEN iqr > 0 THEN iqr ELSE 1 END, 6) AS score, 'IQR' AS anomaly_type,
              round(value, 6) AS value, round(lower_bound, 6) + 0.0 AS lower_bound, round(upper_bound, 6) AS upper_bound
       FROM num_long JOIN fences_v USING (dataset_id, version_number, column_name) WHERE value < lower_bound OR value > upper_bound""",
)
def iqr(spark, root):
    return r4(anomaly.iqr_anomalies(inputs.dirty_orders(spark, root), K, ["o_orderkey"]), 6)


@query(
    "k05_anomaly_summary",
    """SELECT anomaly_type, count(*) AS anomalies, count(DISTINCT (dataset_id, version_number)) AS runs_with_anomalies FROM (
         SELECT 'IQR' AS anomaly_type, dataset_id, version_number FROM num_long JOIN fences_v USING (dataset_id, version_number, column_name) WHERE value < lower_bound OR value > upper_bound
         UNION ALL SELECT 'Z_SCORE', dataset_id, version_number FROM num_long JOIN fences_v USING (dataset_id, version_number, column_name) WHERE n > 2 AND std > 0 AND abs(value - mean) / std > 3.0)
       GROUP BY 1""",
)
def anomaly_summary(spark, root):
    d = inputs.dirty_orders(spark, root)
    cols = [*K, "anomaly_type"]
    rows = detectors.detect(d, K, ["o_orderkey"]).select(cols).unionByName(detectors.detect(d, K, ["o_orderkey"], "z-score").select(cols))
    return rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).groupBy("anomaly_type").agg(
        F.sum("n").alias("anomalies"), F.count(F.lit(1)).alias("runs_with_anomalies")
    )


@query("k03_isolation_forest")
def isolation_forest(spark, root):
    """Whole line items on four measures; the model is random, so rows only."""
    from relyframe.operators.forest import isolation_forest as detect

    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", *cols)
    found = detect(li, ["l_orderkey", "l_linenumber"], cols)
    return r4(found.select("l_orderkey", "l_linenumber", *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(cols)], "score"))


@query(
    "k04_local_outlier_factor",
    """WITH p AS (SELECT c_custkey AS id, c_acctbal AS a, c_nationkey::DOUBLE AS b FROM customer),
       nb AS (SELECT * FROM (SELECT p.id, q.id AS nid, sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)) AS d,
                row_number() OVER (PARTITION BY p.id ORDER BY sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)), q.a, q.b) AS r
              FROM p JOIN p q ON p.id <> q.id) WHERE r <= 20),
       kd AS (SELECT id, max(d) AS kd FROM nb GROUP BY 1),
       lrd AS (SELECT nb.id, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM nb JOIN kd ON kd.id = nid GROUP BY 1),
       lof AS (SELECT nb.id, avg(n.lrd) / max(s.lrd) AS lof FROM nb JOIN lrd n ON n.id = nid JOIN lrd s ON s.id = nb.id GROUP BY 1),
       cut AS (SELECT quantile_cont(-lof, 0.05) AS c FROM lof)
       SELECT id AS c_custkey, round(lof, 4) AS score FROM lof, cut WHERE -lof < c""",
)
def local_outlier_factor(spark, root):
    from relyframe.operators.density import lof_anomalies

    c = table(spark, root, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("double"))
    return r4(lof_anomalies(c, ["c_custkey"], ["c_acctbal", "c_nationkey"]).select("c_custkey", "score"))


@query("k04_lof_orders")
def lof_orders(spark, root):
    """Whole orders on price and customer; too many pairs for plain SQL, so checked on fixtures."""
    from relyframe.operators.density import lof_anomalies

    return r4(lof_anomalies(table(spark, root, "orders"), ["o_orderkey"], ["o_totalprice", "o_custkey"]).select("o_orderkey", "score"))


_D = "dataset_id, version_number, column_name, drift_metric, round(drift_score, 4) + 0.0 AS drift_score, severity"


def _baselines(spark, root):
    return drift.with_broadcast(drift.pick_baselines(inputs.versions(spark, root)))


def _numeric(spark, root):
    d = inputs.dirty_orders(spark, root)
    return drift.numeric_drift(d, _baselines(spark, root), profile.numeric_columns(d, K))


def _text(spark, root):
    return drift.text_drift(inputs.dirty_orders(spark, root), _baselines(spark, root), ["o_orderstatus", "o_orderdate"])


def _metric(name, metric, source):
    def run(spark, root):
        return r4(source(spark, root).where(F.col("drift_metric") == metric))

    run.__doc__ = f"{metric} of every version against the first version of its dataset."
    query(name, f"SELECT {_D} FROM drift_v WHERE drift_metric = '{metric}'")(run)


_metric("l01_psi", "PSI", _numeric)
_metric("l02_mean_shift", "MEAN_SHIFT", _numeric)
_metric("l03_std_shift", "STD_SHIFT", _numeric)
_metric("l04_distribution_drift", "DIST_DRIFT", _text)
_metric("l05_cardinality_drift", "CARD_DRIFT", _text)


@query(
    "l02_known_shift",
    """SELECT t.dataset_id, t.version_number, round(abs(t.m - b.m) / abs(b.m), 4) AS drift_score,
              CASE WHEN abs(t.m - b.m) / abs(b.m) > 0.25 THEN 'HIGH' WHEN abs(t.m - b.m) / abs(b.m) > 0.10 THEN 'MEDIUM' ELSE 'LOW' END AS severity
       FROM (SELECT dataset_id, version_number, avg(o_totalprice) AS m FROM shifted_orders GROUP BY ALL) t
       JOIN (SELECT dataset_id, avg(o_totalprice) AS m FROM shifted_orders WHERE version_number = 1 GROUP BY ALL) b USING (dataset_id) WHERE version_number > 1""",
)
def known_shift(spark, root):
    d = inputs.shifted_orders(spark, root)
    found = drift.numeric_drift(d, _baselines(spark, root), ["o_totalprice"]).where("drift_metric = 'MEAN_SHIFT'")
    return r4(found.select(*K, "drift_score", "severity"))


@query("l06_overall_drift", "SELECT dataset_id, version_number, round(overall_drift_score, 4) AS overall_drift_score FROM overall_v")
def overall(spark, root):
    return r4(drift.overall_drift(reports.drift_facts(spark, root)))


@query("l07_drift_severity", "SELECT drift_metric, severity, count(*) AS columns_affected FROM drift_v GROUP BY ALL")
def drift_severity(spark, root):
    return reports.drift_facts(spark, root).groupBy("drift_metric", "severity").agg(F.count(F.lit(1)).alias("columns_affected"))


@query(
    "l08_drift_runs",
    """SELECT dataset_id, version_number, CAST(created_at AS VARCHAR) AS created_at, round(overall_drift_score, 4) AS overall_drift_score,
              (SELECT string_agg(column_name || '/' || drift_metric || '/' || severity, ',' ORDER BY column_name, drift_metric) FROM drift_v d
               WHERE d.dataset_id = o.dataset_id AND d.version_number = o.version_number) AS column_results
       FROM overall_v o JOIN (SELECT dataset_id, version_number, created_at FROM versions_v) USING (dataset_id, version_number)""",
)
def drift_runs(spark, root):
    """Runs of each dataset, newest first; children are bounded by columns and metrics."""
    d = reports.drift_facts(spark, root)
    line = F.concat_ws("/", "column_name", "drift_metric", "severity")
    kids = d.groupBy(*K).agg(F.array_join(F.sort_array(F.collect_list(line)), ",").alias("column_results"))
    runs = drift.overall_drift(d).join(inputs.versions(spark, root).select(*K, "created_at"), K)
    return r4(runs.join(kids, K).select(*K, "created_at", "overall_drift_score", "column_results").orderBy("dataset_id", F.desc("created_at")))


_PAIRS = "(SELECT dataset_id, version_number AS target_version, version_number - 1 AS source_version FROM versions_v WHERE version_number > 1)"


def _pairs(spark, root):
    p = schema.previous_versions(inputs.versions(spark, root)).where("previous_version IS NOT NULL")
    return p.select("dataset_id", F.col("previous_version").alias("source_version"), F.col("version_number").alias("target_version"))


@query(
    "m01_version_delta",
    f"""SELECT p.dataset_id, source_version, target_version, t.row_count - s.row_count AS row_delta, tc.c - sc.c AS column_delta,
              round(t.health_score - s.health_score, 4) + 0.0 AS health_delta, round(t.quality_score - s.quality_score, 4) + 0.0 AS quality_delta,
              round(t.anomaly_score - s.anomaly_score, 4) + 0.0 AS anomaly_delta, round(t.drift_score - s.drift_score, 4) + 0.0 AS drift_delta
       FROM {_PAIRS} p JOIN reports_v s ON s.dataset_id = p.dataset_id AND s.version_number = source_version
       JOIN reports_v t ON t.dataset_id = p.dataset_id AND t.version_number = target_version
       JOIN (SELECT dataset_id, version_number, count(*) AS c FROM schema_rows GROUP BY ALL) sc ON sc.dataset_id = p.dataset_id AND sc.version_number = source_version
       JOIN (SELECT dataset_id, version_number, count(*) AS c FROM schema_rows GROUP BY ALL) tc ON tc.dataset_id = p.dataset_id AND tc.version_number = target_version""",
)
def version_delta(spark, root):
    """Columns are those that each version of the raw table has."""
    r = reports.reports(spark, root)
    raw = profile.column_stats(inputs.raw_orders(spark, root), K)
    return r4(schema.version_deltas(schema.present_summary(raw, contracting.schema_facts(spark, root)), r, _pairs(spark, root)))


@query(
    "d03_present_columns",
    """SELECT dataset_id, version_number, n AS row_count, count(*) AS column_count, CAST(sum(n - filled) AS BIGINT) AS missing_cells_count, round(sum(n - filled) * 100.0::DOUBLE / (max(n) * count(*)), 4) AS missing_cells_percent
       FROM (SELECT dataset_id, version_number, column_name, count(*) AS filled FROM raw_long GROUP BY ALL) JOIN (SELECT dataset_id, version_number, count(*) AS n FROM dirty_orders GROUP BY ALL) USING (dataset_id, version_number)
       GROUP BY dataset_id, version_number, n""",
)
def present_columns(spark, root):
    """Missing cells of a version do not count columns that it does not have."""
    raw = inputs.raw_orders(spark, root)
    return r4(schema.present_summary(profile.column_stats(raw, K), schema.infer_types(raw, K)))


@query(
    "m02_column_deltas",
    f"""SELECT p.dataset_id, source_version, target_version, t.column_name, round(t.missing_percent - s.missing_percent, 4) + 0.0 AS null_delta, t.unique_count - s.unique_count AS cardinality_delta,
              round(coalesce(t.mean - s.mean, 0), 4) + 0.0 AS mean_delta, round(coalesce(t.median - s.median, 0), 4) + 0.0 AS median_delta, round(coalesce(t.std - s.std, 0), 4) + 0.0 AS std_delta
       FROM {_PAIRS} p JOIN profiles_v s ON s.dataset_id = p.dataset_id AND s.version_number = source_version
       JOIN profiles_v t ON t.dataset_id = p.dataset_id AND t.version_number = target_version AND t.column_name = s.column_name""",
)
def column_deltas(spark, root):
    return r4(schema.column_deltas(reports.profiles(spark, root), _pairs(spark, root)))


@query(
    "m03_schema_hash",
    """SELECT dataset_id, version_number, md5('{' || string_agg('"' || column_name || '": "' || data_type || '"', ', ' ORDER BY column_name) || '}') AS schema_hash FROM schema_rows GROUP BY ALL""",
)
def schema_hash(spark, root):
    return schema.schema_hash(contracting.schema_facts(spark, root), K)


@query(
    "m04_schema_diff",
    """WITH j AS (SELECT coalesce(n.dataset_id, o.dataset_id) AS dataset_id, coalesce(n.version_number, o.version_number) AS version_number,
                  coalesce(n.column_name, o.column_name) AS column_name, o.data_type AS old_value, n.data_type AS new_value
         FROM (SELECT * FROM schema_rows WHERE version_number > 1) n
         FULL JOIN (SELECT dataset_id, version_number + 1 AS version_number, column_name, data_type FROM schema_rows WHERE version_number < 7) o
           ON n.dataset_id = o.dataset_id AND n.version_number = o.version_number AND n.column_name = o.column_name)
       SELECT *, CASE WHEN old_value IS NULL THEN 'ADDED' WHEN new_value IS NULL THEN 'REMOVED' ELSE 'TYPE_CHANGE' END AS change_type, old_value IS NOT NULL AS is_breaking
       FROM j WHERE old_value IS DISTINCT FROM new_value""",
)
def schema_diff(spark, root):
    return schema.schema_changes(contracting.schema_facts(spark, root))


@query(
    "m05_semantic_catalog",
    """SELECT dataset_id, version_number, column_name, data_type, semantic_type, pii_class,
              CASE semantic_type || pii_class WHEN 'IDENTIFIERNONE' THEN 'Unique database identifier or foreign reference key.' WHEN 'PIIEMAIL' THEN 'Personally identifiable email address contact field.'
                   WHEN 'PIIPHONE' THEN 'Personally identifiable telephone contact field.' WHEN 'PIINAME' THEN 'Personally identifiable name descriptor.'
                   WHEN 'PIIADDRESS' THEN 'Personally identifiable postal street address.' WHEN 'PIIIP' THEN 'Network server Internet Protocol address.'
                   WHEN 'FINANCIALNONE' THEN 'Corporate financial ledger metric currency value.' WHEN 'GEOGRAPHYNONE' THEN 'Geographical territorial location metadata.'
                   WHEN 'TEMPORALNONE' THEN 'Temporal transaction audit log datetime marker.' ELSE 'Column containing raw ' || column_name || ' values.' END AS meaning FROM catalog_v""",
)
def semantic_catalog(spark, root):
    return schema.semantic_catalog(schema.infer_types(inputs.raw_orders(spark, root), K))


@query(
    "m06_sensitivity",
    """SELECT dataset_id, version_number, CASE WHEN max(c) OVER (PARTITION BY dataset_id ORDER BY version_number) > 0 THEN 'CONFIDENTIAL' ELSE 'PUBLIC' END AS sensitivity_level
       FROM (SELECT dataset_id, version_number, count(*) FILTER (WHERE semantic_type = 'PII') AS c FROM catalog_v GROUP BY ALL)""",
)
def sensitivity(spark, root):
    """The level after each version: never lowered by a later one."""
    from pyspark.sql import Window

    cat = schema.semantic_catalog(contracting.schema_facts(spark, root))
    per = cat.groupBy(*K).agg(F.max((F.col("semantic_type") == "PII").cast("int")).alias("pii"))
    upto = Window.partitionBy("dataset_id").orderBy("version_number")
    return per.select(*K, F.when(F.max("pii").over(upto) > 0, "CONFIDENTIAL").otherwise("PUBLIC").alias("sensitivity_level"))


@query(
    "m06_dataset_sensitivity",
    """SELECT dataset_id, count(*) FILTER (WHERE version_number = 7 AND semantic_type = 'PII') AS pii_columns,
              CASE WHEN bool_or(semantic_type = 'PII') THEN 'CONFIDENTIAL' ELSE 'PUBLIC' END AS sensitivity_level FROM catalog_v GROUP BY dataset_id""",
)
def dataset_sensitivity(spark, root):
    """The newest version's columns, with the level that earlier versions gave."""
    catalog = schema.semantic_catalog(contracting.schema_facts(spark, root))
    before = schema.sensitivity(catalog.where(F.col("version_number") < inputs.LAST_VERSION))
    return schema.sensitivity(catalog.where(F.col("version_number") == inputs.LAST_VERSION), before)
