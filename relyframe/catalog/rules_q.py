"""I, J: quality rules and data contracts."""

from pyspark.sql import functions as F

from relyframe.catalog.registry import query, r4
from relyframe.operators import contracts, profile, quality
from relyframe.plans import contracting, reports
from relyframe.sources import inputs
from relyframe.sources.tables import table

K = inputs.KEYS
_ROW = "dataset_id, version_number, rule_id, severity, column_name, round(actual_value, 4) AS actual_value, round(expected_value, 4) AS expected_value, message"


def _one_rule(spark, root, rule_id, targets=None):
    rules = [r for r in reports.RULES if r[0] == rule_id]
    return r4(quality.violations(spark, inputs.dirty_orders(spark, root), K, rules, targets))


def _add(name, rule_id, doc):
    def run(spark, root):
        return _one_rule(spark, root, rule_id)

    run.__doc__ = doc
    query(name, f"SELECT {_ROW} FROM violations_v WHERE rule_id = {rule_id}")(run)


_add("i01_null_percent", 1, "Share of empty cells above the limit.")
_add("i02_duplicate_percent", 2, "Share of repeated rows above the limit.")
_add("i03_column_null_percent", 3, "Share of nulls of one column above the limit.")
_add("i04_column_min", 4, "Smallest value below the limit.")
_add("i05_column_max", 5, "Largest value above the limit.")
_add("i06_column_regex", 6, "Share of values not matching a pattern.")
_add("i07_column_unique", 7, "Share of repeated values of one column.")


@query("i08_referential", f"SELECT {_ROW} FROM violations_v WHERE rule_id = 9")
def referential(spark, root):
    return _one_rule(spark, root, 9, {"lineitem": table(spark, root, "lineitem")})


@query(
    "i09_severity_from_name",
    """SELECT o_orderkey, CASE WHEN upper(n) LIKE '%CRITICAL%' THEN 'critical' WHEN upper(n) LIKE '%HIGH%' THEN 'high' WHEN upper(n) LIKE '%MEDIUM%' THEN 'medium' ELSE 'low' END AS severity
       FROM (SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'Critical ' ELSE '' END || o_orderpriority AS n FROM orders)""",
)
def severity_from_name(spark, root):
    name = F.concat(F.when(F.col("o_custkey") % 5 == 0, "Critical ").otherwise(""), "o_orderpriority")
    return table(spark, root, "orders").select("o_orderkey", quality.severity_from_name(name).alias("severity"))


ABSENT_RULES = [
    (21, "Comment nulls MEDIUM", "COLUMN_NULL_PERCENT:o_comment", 5.0, True),
    (22, "Unique clerk CRITICAL", "COLUMN_UNIQUE:o_clerk", 0.0, True),
    (23, "Price nulls", "COLUMN_NULL_PERCENT:o_totalprice", 5.8, True),
]


@query(
    "i10_missing_column",
    """SELECT dataset_id, version_number, r.rule_id, r.severity, r.column_name, NULL::DOUBLE AS actual_value, NULL::DOUBLE AS expected_value, r.message
       FROM (SELECT DISTINCT dataset_id, version_number FROM dirty_orders),
            (VALUES (21, 'medium', 'o_comment', 'Column ''o_comment'' not found in dataset'), (22, 'critical', 'o_clerk', 'Column ''o_clerk'' not found')) r(rule_id, severity, column_name, message)
       UNION ALL SELECT dataset_id, version_number, 23, 'low', column_name, round(actual_value, 4), round(expected_value, 4), message FROM violations_v WHERE rule_id = 3""",
)
def missing_column(spark, root):
    return r4(quality.violations(spark, inputs.dirty_orders(spark, root), K, ABSENT_RULES))


PROFILE_RULES = [
    (1, "Nulls", "NULL_PERCENT", 1.8, True),
    (2, "Duplicates", "DUPLICATE_PERCENT", 9.0, True),
    (3, "Price nulls", "COLUMN_NULL_PERCENT:o_totalprice", 5.8, True),
    (4, "Price floor", "COLUMN_MIN:o_totalprice", 1100.0, True),
    (5, "Price ceiling", "COLUMN_MAX:o_totalprice", 9000000.0, True),
    (6, "Status floor", "COLUMN_MIN:o_orderstatus", 1.0, True),
    (7, "Comment nulls", "COLUMN_NULL_PERCENT:o_comment", 5.0, True),
    (8, "Odd kind", "COLUMN_SHAPE:o_comment", 5.0, True),
    (9, "Off", "NULL_PERCENT", 0.0, False),
]


@query(
    "i11_profile_validation",
    """WITH j AS (SELECT s.dataset_id, s.version_number, r.*, missing_cells_percent, duplicate_rows_percent, c.missing_percent, c.is_numeric, f.min, f.max
         FROM summary_v s, (VALUES (1, 'Nulls', 'NULL_PERCENT', NULL, 1.8::DOUBLE), (2, 'Duplicates', 'DUPLICATE_PERCENT', NULL, 9.0), (3, 'Price nulls', 'COLUMN_NULL_PERCENT', 'o_totalprice', 5.8),
           (4, 'Price floor', 'COLUMN_MIN', 'o_totalprice', 1100.0), (5, 'Price ceiling', 'COLUMN_MAX', 'o_totalprice', 9000000.0), (6, 'Status floor', 'COLUMN_MIN', 'o_orderstatus', 1.0),
           (7, 'Comment nulls', 'COLUMN_NULL_PERCENT', 'o_comment', 5.0), (8, 'Odd kind', 'COLUMN_SHAPE', 'o_comment', 5.0)) r(rule_id, rule_name, kind, col, threshold)
         LEFT JOIN col_counts c ON c.dataset_id = s.dataset_id AND c.version_number = s.version_number AND c.column_name = r.col
         LEFT JOIN fences_v f ON f.dataset_id = s.dataset_id AND f.version_number = s.version_number AND f.column_name = r.col),
       a AS (SELECT *, CASE kind WHEN 'NULL_PERCENT' THEN missing_cells_percent WHEN 'DUPLICATE_PERCENT' THEN duplicate_rows_percent WHEN 'COLUMN_NULL_PERCENT' THEN missing_percent
                         WHEN 'COLUMN_MIN' THEN min WHEN 'COLUMN_MAX' THEN max END AS actual FROM j),
       e AS (SELECT *, CASE WHEN kind = 'COLUMN_SHAPE' THEN 'Unsupported rule type: COLUMN_SHAPE:o_comment'
            WHEN col IS NOT NULL AND is_numeric IS NULL THEN 'Column ''' || col || ''' not found in dataset'
            WHEN kind IN ('COLUMN_MIN', 'COLUMN_MAX') AND NOT is_numeric THEN 'Column ''' || col || ''' is not numeric'
            WHEN kind = 'NULL_PERCENT' AND actual > threshold THEN printf('Overall null percent %.2f%% exceeds threshold %.2f%%', actual, threshold)
            WHEN kind = 'DUPLICATE_PERCENT' AND actual > threshold THEN printf('Duplicate rows percent %.2f%% exceeds threshold %.2f%%', actual, threshold)
            WHEN kind = 'COLUMN_NULL_PERCENT' AND actual > threshold THEN printf('Column ''%s'' null percent %.2f%% exceeds threshold %.2f%%', col, actual, threshold)
            WHEN kind = 'COLUMN_MIN' AND actual < threshold THEN printf('Column ''%s'' min value %.2f is below threshold %.2f', col, actual, threshold)
            WHEN kind = 'COLUMN_MAX' AND actual > threshold THEN printf('Column ''%s'' max value %.2f is above threshold %.2f', col, actual, threshold) ELSE '' END AS error_message FROM a)
       SELECT dataset_id, version_number, rule_id, rule_name, round(actual, 4) AS actual_value, error_message = '' AS passed, error_message,
              bool_and(error_message = '') OVER (PARTITION BY dataset_id, version_number) AS all_passed FROM e""",
)
def profile_validation(spark, root):
    d = inputs.dirty_orders(spark, root)
    checks = quality.check_profile(spark, profile.table_summary(d, K), profile.column_stats(d, K), K, PROFILE_RULES)
    everything = checks.groupBy(*K).agg(F.bool_and("passed").alias("all_passed"))
    return r4(checks.join(everything, K).select(*K, "rule_id", "rule_name", "actual_value", "passed", "error_message", "all_passed"))


@query(
    "i12_run_summary",
    """SELECT dataset_id, version_number, 8 AS rules_checked, coalesce(c, 0) AS total_violations FROM (SELECT DISTINCT dataset_id, version_number FROM dirty_orders)
       LEFT JOIN (SELECT dataset_id, version_number, count(*) AS c FROM violations_v GROUP BY ALL) USING (dataset_id, version_number)""",
)
def run_summary(spark, root):
    found = reports.violation_facts(spark, root).groupBy(*K).agg(F.count(F.lit(1)).alias("c"))
    checked = sum(1 for r in reports.RULES if r[4])
    groups = inputs.versions(spark, root).select(*K)
    return groups.join(found, K, "left").select(*K, F.lit(checked).alias("rules_checked"), F.coalesce("c", F.lit(0)).alias("total_violations"))


_CROW = "dataset_id, version_number, contract_id, rule_id, rule_type, column_name, severity, message"


def _contract(name, kind):
    def run(spark, root):
        from relyframe.operators import schema

        raw = inputs.raw_orders(spark, root)
        rules = [r for r in contracting.RULES if r[2] == kind]
        rates = quality.uniqueness_rates(raw, K, ["order_id"]) if kind == "uniqueness" else None
        types = schema.semantic_catalog(contracting.schema_facts(spark, root))
        return contracts.check_contracts(spark, raw, K, contracting.contract_table(spark, root), rules, types, rates)

    run.__doc__ = f"Contract rule {kind}."
    query(name, f"SELECT {_CROW} FROM contract_violations_v WHERE rule_type = '{kind}'")(run)


_contract("j01_column_exists", "column_exists")
_contract("j02_column_type", "column_type")
_contract("j03_max_null_pct", "max_null_pct")
_contract("j04_uniqueness", "uniqueness")
_contract("j05_regex", "regex")
_contract("j06_range", "range")


@query(
    "j07_active_contract",
    """SELECT contract_id, dataset_id, CASE WHEN row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, contract_id DESC) = 1 THEN 'active' ELSE 'deprecated' END AS status FROM contracts_v""",
)
def active_contract(spark, root):
    return contracts.with_status(contracting.contract_table(spark, root)).select("contract_id", "dataset_id", "status")


@query(
    "j08_contract_schema_hash",
    "SELECT dataset_id, version_number, sha256(string_agg(column_name, ',' ORDER BY column_name)) AS schema_hash FROM schema_rows GROUP BY ALL",
)
def contract_schema_hash(spark, root):
    return contracts.schema_hash(contracting.schema_facts(spark, root), K)


@query(
    "j09_violation_report",
    """SELECT contract_id, rule_id, rule_type, severity, count(*) AS violations, min(version_number) AS first_version, max(version_number) AS last_version FROM contract_violations_v GROUP BY ALL""",
)
def violation_report(spark, root):
    return contracting.contract_violations(spark, root).groupBy("contract_id", "rule_id", "rule_type", "severity").agg(
        F.count(F.lit(1)).alias("violations"), F.min("version_number").alias("first_version"), F.max("version_number").alias("last_version")
    )
