"""SQL forms of the derived inputs and shared results, used by the check SQL."""

from __future__ import annotations

_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
_TXT = ["o_orderstatus", "o_orderdate"]
_ALL = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]


def _union(rows: list[str]) -> str:
    return " UNION ALL ".join(rows)


VIEWS: dict[str, str] = {}

VIEWS["orders_v"] = """
SELECT o_orderpriority AS dataset_id, CAST(year(o_orderdate) - 1994 AS INTEGER) AS version_number,
       o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders"""

VIEWS["dirty_base"] = """
SELECT dataset_id, version_number, o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 17 = version_number THEN NULL
            WHEN o_orderkey % 101 = 0 THEN o_totalprice * 20 ELSE o_totalprice END AS o_totalprice,
       o_orderdate FROM orders_v"""

VIEWS["dirty_orders"] = """
SELECT * FROM dirty_base UNION ALL SELECT * FROM dirty_base WHERE o_orderkey % 50 < version_number"""

VIEWS["shifted_orders"] = """
SELECT dataset_id, version_number, o_orderkey, o_custkey, o_orderstatus,
       o_totalprice * (1 + CAST(0.05 AS DOUBLE) * version_number) AS o_totalprice, o_orderdate FROM orders_v"""

VIEWS["raw_orders"] = """
SELECT dataset_id, version_number, CAST(o_orderkey AS VARCHAR) AS order_id,
       CASE WHEN version_number < 3 THEN CAST(o_custkey AS VARCHAR) END AS buyer_name,
       CASE WHEN version_number >= 3 THEN CAST(o_custkey AS VARCHAR) END AS customer_id,
       CASE WHEN version_number >= 5 THEN CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2' WHEN 'P' THEN '3' END
            ELSE o_orderstatus END AS state_code,
       CASE WHEN version_number >= 6 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)
            ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.5' END AS total_price,
       strftime(o_orderdate, '%Y-%m-%d') AS created_date
FROM dirty_orders"""

VIEWS["raw_long"] = _union(
    [
        f"SELECT dataset_id, version_number, '{c}' AS column_name, {c} AS value FROM raw_orders WHERE {c} IS NOT NULL"
        for c in ["order_id", "buyer_name", "customer_id", "state_code", "total_price", "created_date"]
    ]
)

VIEWS["schema_rows"] = r"""
SELECT k.dataset_id, k.version_number, k.column_name,
       CASE WHEN ints AND filled = row_count THEN 'int64' WHEN nums THEN 'float64'
            WHEN bools AND filled = row_count THEN 'bool' ELSE 'object' END AS data_type
FROM (SELECT dataset_id, version_number, column_name, count(*) AS filled,
             bool_and(regexp_matches(value, '^[+-]?[0-9]+$')) AS ints,
             bool_and(regexp_matches(value, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')) AS nums,
             bool_and(regexp_matches(value, '^(True|False|TRUE|FALSE|true|false)$')) AS bools
      FROM raw_long GROUP BY ALL) k
JOIN (SELECT dataset_id, version_number, count(*) AS row_count FROM dirty_orders GROUP BY ALL) n
  USING (dataset_id, version_number)"""

VIEWS["dataset_dim"] = """
SELECT DISTINCT o_orderpriority AS dataset_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS dataset_no,
       split_part(o_orderpriority, '-', 2) AS dataset_name FROM orders"""

VIEWS["versions_v"] = """
SELECT dataset_id, version_number, count(*) AS row_count,
       TIMESTAMP '2024-02-01 00:00:00' - to_hours(CAST((7 - version_number) * 24 + 6 * CAST(substr(dataset_id, 1, 1) AS INTEGER) AS BIGINT)) AS created_at
FROM orders_v GROUP BY dataset_id, version_number"""

VIEWS["incidents_v"] = """
SELECT event_id AS incident_id, CAST(user_id % 5 + 1 AS INTEGER) AS dataset_no,
       CAST(day(ts) % 7 + 1 AS INTEGER) AS version_number,
       CASE event_id % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'INVESTIGATING' ELSE 'RESOLVED' END AS status,
       CASE WHEN value > 100 THEN 'critical' WHEN value > 50 THEN 'high' WHEN value > 20 THEN 'medium' ELSE 'low' END AS severity,
       ts AS created_at, value, user_id
FROM events WHERE event_type = 'error'"""

VIEWS["refreshes_v"] = """
SELECT event_id AS record_id, CAST(user_id % 5 + 1 AS INTEGER) AS dataset_no,
       date_trunc('hour', ts) + to_minutes(CAST(user_id % 60 - (user_id % 4) * 30 AS BIGINT)) AS expected_time,
       ts AS actual_time FROM events"""

VIEWS["freshness_v"] = """
SELECT *, CASE WHEN delay_minutes = 0 THEN 'on_time' WHEN delay_minutes < 60 THEN 'late' ELSE 'critical' END AS status
FROM (SELECT *, CAST(greatest(0, trunc((epoch_us(actual_time) - epoch_us(expected_time)) / 60000000.0)) AS INTEGER) AS delay_minutes
      FROM refreshes_v)"""

VIEWS["edges_v"] = """
SELECT CAST((c_custkey - 1) // 2 AS BIGINT) AS src, c_custkey AS dst, 'derived_from' AS relationship FROM customer WHERE c_custkey > 0
UNION ALL
SELECT c_custkey AS src, CAST((c_custkey - 1) // 2 AS BIGINT) AS dst, 'feeds_back' AS relationship
FROM customer WHERE c_custkey > 0 AND c_custkey % 97 = 0"""

VIEWS["num_long"] = _union(
    [
        f"SELECT dataset_id, version_number, o_orderkey AS row_key, '{c}' AS column_name, CAST({c} AS DOUBLE) AS value "
        f"FROM dirty_orders WHERE {c} IS NOT NULL"
        for c in _NUM
    ]
)
VIEWS["text_long"] = _union(
    [
        f"SELECT dataset_id, version_number, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM dirty_orders WHERE {c} IS NOT NULL"
        for c in _TXT
    ]
)
VIEWS["cells_long"] = _union(
    [
        f"SELECT dataset_id, version_number, '{c}' AS column_name, {str(c in _NUM).lower()} AS is_numeric, CAST({c} AS VARCHAR) AS value FROM dirty_orders"
        for c in _ALL
    ]
)

VIEWS["summary_v"] = """
SELECT dataset_id, version_number, row_count, 5 AS column_count, row_count - distinct_rows AS duplicate_rows_count,
       (row_count - distinct_rows) * CAST(100.0 AS DOUBLE) / row_count AS duplicate_rows_percent,
       row_count * 5 AS total_cells, missing_cells_count,
       missing_cells_count * CAST(100.0 AS DOUBLE) / (row_count * 5) AS missing_cells_percent
FROM (SELECT dataset_id, version_number, CAST(sum(c) AS BIGINT) AS row_count, count(*) AS distinct_rows,
             CAST(sum(c * ((o_totalprice IS NULL)::INT + (o_orderstatus IS NULL)::INT)) AS BIGINT) AS missing_cells_count
      FROM (SELECT *, count(*) AS c FROM dirty_orders GROUP BY ALL) GROUP BY dataset_id, version_number)"""

VIEWS["fences_v"] = """
SELECT *, p75 - p25 AS iqr, p25 - 1.5 * (p75 - p25) AS lower_bound, p75 + 1.5 * (p75 - p25) AS upper_bound
FROM (SELECT dataset_id, version_number, column_name, count(*) AS n, quantile_cont(value, 0.25) AS p25,
             quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS p75,
             min(value) AS min, max(value) AS max, avg(value) AS mean,
             CASE WHEN count(*) < 2 THEN 0.0 ELSE stddev_samp(value) END AS std
      FROM num_long GROUP BY dataset_id, version_number, column_name)"""

VIEWS["outliers_v"] = """
SELECT dataset_id, version_number, column_name, count(*) FILTER (WHERE value < lower_bound OR value > upper_bound) AS outlier_count
FROM num_long JOIN fences_v USING (dataset_id, version_number, column_name) GROUP BY ALL"""

VIEWS["col_counts"] = """
SELECT dataset_id, version_number, column_name, is_numeric, count(*) AS row_count, count(*) - count(value) AS missing_count,
       (count(*) - count(value)) * CAST(100.0 AS DOUBLE) / count(*) AS missing_percent, count(DISTINCT value) AS unique_count,
       count(DISTINCT value) * CAST(100.0 AS DOUBLE) / count(*) AS unique_percent
FROM cells_long GROUP BY ALL"""

VIEWS["tops_v"] = """
SELECT dataset_id, version_number, column_name, value, cnt, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY dataset_id, version_number, column_name ORDER BY cnt DESC, value) AS INTEGER) AS rank
  FROM (SELECT dataset_id, version_number, column_name, value, count(*) AS cnt FROM text_long GROUP BY ALL)) WHERE rank <= 10"""

VIEWS["profiles_v"] = """
SELECT c.dataset_id, c.version_number, c.column_name, is_numeric, row_count, missing_count, missing_percent, unique_count, unique_percent,
       min, max, mean, median, std, p25, p75, outlier_count, top_values
FROM col_counts c LEFT JOIN fences_v f USING (dataset_id, version_number, column_name)
LEFT JOIN outliers_v o USING (dataset_id, version_number, column_name)
LEFT JOIN (SELECT dataset_id, version_number, column_name, string_agg(value || '=' || cnt, '|' ORDER BY rank) AS top_values
           FROM tops_v GROUP BY ALL) t USING (dataset_id, version_number, column_name)"""

VIEWS["rule_stats"] = """
SELECT dataset_id, version_number, count(*) AS n, count(o_totalprice) AS price_n, min(o_totalprice) AS price_min, max(o_totalprice) AS price_max,
       count(o_orderstatus) AS status_n, count(*) FILTER (WHERE NOT regexp_matches(o_orderstatus, '^(?:[FO])')) AS status_bad,
       count(DISTINCT o_orderkey) AS keys_distinct,
       count(DISTINCT o_orderkey) FILTER (WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS keys_missing
FROM dirty_orders GROUP BY dataset_id, version_number"""

VIEWS["violations_v"] = """
SELECT dataset_id, version_number, 1 AS rule_id, 'high' AS severity, CAST(NULL AS VARCHAR) AS column_name, missing_cells_percent AS actual_value, 1.8::DOUBLE AS expected_value,
       printf('Overall null percent %.2f%% exceeds threshold %.2f%%', missing_cells_percent, 1.8::DOUBLE) AS message
FROM summary_v WHERE missing_cells_percent > 1.8
UNION ALL
SELECT dataset_id, version_number, 2, 'critical', NULL, duplicate_rows_percent, 9.0,
       printf('Duplicate rows percent %.2f%% exceeds threshold %.2f%%', duplicate_rows_percent, 9.0::DOUBLE)
FROM summary_v WHERE duplicate_rows_percent > 9.0
UNION ALL
SELECT dataset_id, version_number, 3, 'medium', 'o_totalprice', a, 5.8, printf('Column ''o_totalprice'' null percent %.2f%% exceeds threshold %.2f%%', a, 5.8::DOUBLE)
FROM (SELECT *, (n - price_n) * 100.0::DOUBLE / n AS a FROM rule_stats) WHERE a > 5.8
UNION ALL
SELECT dataset_id, version_number, 4, 'low', 'o_totalprice', price_min, 1100.0, printf('Column ''o_totalprice'' minimum %.2f is below threshold %.2f', price_min, 1100.0::DOUBLE)
FROM rule_stats WHERE price_min < 1100.0
UNION ALL
SELECT dataset_id, version_number, 5, 'critical', 'o_totalprice', price_max, 9000000.0, printf('Column ''o_totalprice'' maximum %.2f exceeds threshold %.2f', price_max, 9000000.0::DOUBLE)
FROM rule_stats WHERE price_max > 9000000.0
UNION ALL
SELECT dataset_id, version_number, 6, 'high', 'o_orderstatus', a, 32.5, printf('Column ''o_orderstatus'' regex mismatch rate %.2f%% exceeds threshold %.2f%%', a, 32.5::DOUBLE)
FROM (SELECT *, status_bad * 100.0::DOUBLE / status_n AS a FROM rule_stats) WHERE a > 32.5
UNION ALL
SELECT dataset_id, version_number, 7, 'medium', 'o_orderkey', a, 7.0, printf('Column ''o_orderkey'' uniqueness violation rate %.2f%% exceeds threshold %.2f%%', a, 7.0::DOUBLE)
FROM (SELECT *, (n - keys_distinct) * 100.0::DOUBLE / n AS a FROM rule_stats) WHERE a > 7.0
UNION ALL
SELECT dataset_id, version_number, 9, 'high', 'o_orderkey', a, 1.8, printf('Referential integrity mismatch rate %.2f%% exceeds threshold %.2f%%', a, 1.8::DOUBLE)
FROM (SELECT *, keys_missing * 100.0::DOUBLE / keys_distinct AS a FROM rule_stats) WHERE a > 1.8"""

VIEWS["psi_edges"] = """
SELECT dataset_id, column_name, list_transform(e, lambda x, i: CASE WHEN i = 1 THEN x - 1e-5 WHEN i = len(e) THEN x + 1e-5 ELSE x END) AS edges
FROM (SELECT dataset_id, column_name,
             list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e
      FROM num_long WHERE version_number = 1 GROUP BY dataset_id, column_name) WHERE len(e) >= 2"""

VIEWS["psi_bins"] = """
SELECT dataset_id, column_name, CAST(i AS INTEGER) AS bin, edges[i] AS low, edges[i + 1] AS high, i = len(edges) - 1 AS is_last
FROM (SELECT dataset_id, column_name, edges, unnest(range(1, len(edges))) AS i FROM psi_edges)"""

VIEWS["psi_hist"] = """
SELECT b.dataset_id, g.version_number, b.column_name, b.bin, g.n, coalesce(h.c, 0) AS c
FROM psi_bins b
JOIN (SELECT dataset_id, version_number, column_name, count(*) AS n FROM num_long GROUP BY ALL) g USING (dataset_id, column_name)
LEFT JOIN (SELECT v.dataset_id, v.version_number, v.column_name, p.bin, count(*) AS c FROM num_long v
           JOIN psi_bins p ON v.dataset_id = p.dataset_id AND v.column_name = p.column_name
            AND v.value >= p.low AND (v.value < p.high OR (p.is_last AND v.value = p.high)) GROUP BY ALL) h
  ON h.dataset_id = b.dataset_id AND h.column_name = b.column_name AND h.bin = b.bin AND h.version_number = g.version_number"""

VIEWS["psi_shares"] = """
SELECT *, s / sum(s) OVER (PARTITION BY dataset_id, version_number, column_name) AS p
FROM (SELECT *, c / n::DOUBLE + 1e-4 AS s FROM psi_hist)"""

VIEWS["psi_v"] = """
SELECT t.dataset_id, t.version_number, t.column_name, sum((t.p - b.p) * ln(t.p / b.p)) AS drift_score
FROM psi_shares t JOIN psi_shares b ON b.version_number = 1 AND t.version_number <> 1
 AND t.dataset_id = b.dataset_id AND t.column_name = b.column_name AND t.bin = b.bin GROUP BY ALL"""

VIEWS["moments_v"] = """
SELECT dataset_id, version_number, column_name, avg(value) AS mean, stddev_samp(value) AS std FROM num_long GROUP BY ALL"""

VIEWS["shares_v"] = """
SELECT dataset_id, version_number, column_name, value, count(*) / sum(count(*)) OVER (PARTITION BY dataset_id, version_number, column_name) AS p
FROM text_long GROUP BY dataset_id, version_number, column_name, value"""

VIEWS["dist_v"] = """
SELECT dataset_id, version_number, column_name, least(sum(abs(tp - bp)) / 2, 1.0) AS drift_score FROM (
  SELECT coalesce(t.dataset_id, b.dataset_id) AS dataset_id, coalesce(t.version_number, b.version_number) AS version_number,
         coalesce(t.column_name, b.column_name) AS column_name, coalesce(t.p, 0) AS tp, coalesce(b.p, 0) AS bp
  FROM (SELECT * FROM shares_v WHERE version_number <> 1) t
  FULL JOIN (SELECT s.dataset_id, g.version_number, s.column_name, s.value, s.p FROM shares_v s
             JOIN (SELECT DISTINCT dataset_id, version_number FROM shares_v WHERE version_number <> 1) g USING (dataset_id)
             WHERE s.version_number = 1) b
    ON t.dataset_id = b.dataset_id AND t.version_number = b.version_number AND t.column_name = b.column_name AND t.value = b.value)
GROUP BY dataset_id, version_number, column_name"""

VIEWS["drift_raw"] = """
SELECT dataset_id, version_number, column_name, 'PSI' AS drift_metric, drift_score FROM psi_v
UNION ALL SELECT t.dataset_id, t.version_number, t.column_name, 'MEAN_SHIFT', abs(t.mean - b.mean) / CASE WHEN b.mean <> 0 THEN abs(b.mean) ELSE 1 END
  FROM moments_v t JOIN moments_v b ON b.version_number = 1 AND t.version_number <> 1 AND t.dataset_id = b.dataset_id AND t.column_name = b.column_name
UNION ALL SELECT t.dataset_id, t.version_number, t.column_name, 'STD_SHIFT',
    abs(coalesce(t.std, 0) - CASE WHEN b.std > 0 THEN b.std ELSE 1 END) / CASE WHEN b.std > 0 THEN b.std ELSE 1 END
  FROM moments_v t JOIN moments_v b ON b.version_number = 1 AND t.version_number <> 1 AND t.dataset_id = b.dataset_id AND t.column_name = b.column_name
UNION ALL SELECT dataset_id, version_number, column_name, 'DIST_DRIFT', drift_score FROM dist_v
UNION ALL SELECT t.dataset_id, t.version_number, t.column_name, 'CARD_DRIFT', abs(t.c - b.c) / greatest(b.c, 1)::DOUBLE
  FROM (SELECT dataset_id, version_number, column_name, count(*) AS c FROM shares_v GROUP BY ALL) t
  JOIN (SELECT dataset_id, version_number, column_name, count(*) AS c FROM shares_v GROUP BY ALL) b
    ON b.version_number = 1 AND t.version_number <> 1 AND t.dataset_id = b.dataset_id AND t.column_name = b.column_name"""

VIEWS["drift_v"] = """
SELECT *, CASE WHEN drift_metric = 'CARD_DRIFT' THEN CASE WHEN drift_score > 0.30 THEN 'HIGH' WHEN drift_score > 0.10 THEN 'MEDIUM' ELSE 'LOW' END
               WHEN drift_score > 0.25 THEN 'HIGH' WHEN drift_score > 0.10 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM drift_raw"""

VIEWS["overall_v"] = """
SELECT dataset_id, version_number, avg(least(drift_score, 1.0)) AS overall_drift_score
FROM drift_v WHERE drift_metric IN ('PSI', 'DIST_DRIFT') GROUP BY dataset_id, version_number"""

VIEWS["reports_base"] = """
SELECT s.*, coalesce(v.c, 0) AS violation_count, CAST(coalesce(o.c, 0) AS BIGINT) AS anomaly_count,
       coalesce(d.overall_drift_score, 0) AS overall_drift_score,
       least(missing_cells_percent, 25.0) AS null_penalty, least(duplicate_rows_percent, 25.0) AS duplicate_penalty,
       least(coalesce(v.c, 0) * 5.0::DOUBLE, 30.0) AS violation_penalty, least(coalesce(o.c, 0) * 2.0::DOUBLE, 20.0) AS anomaly_penalty
FROM summary_v s
LEFT JOIN (SELECT dataset_id, version_number, count(*) AS c FROM violations_v GROUP BY ALL) v USING (dataset_id, version_number)
LEFT JOIN (SELECT dataset_id, version_number, sum(outlier_count) AS c FROM outliers_v GROUP BY ALL) o USING (dataset_id, version_number)
LEFT JOIN overall_v d USING (dataset_id, version_number)"""

VIEWS["reports_v"] = """
SELECT b.*, CASE WHEN health_score >= 90 THEN 'Healthy' WHEN health_score >= 75 THEN 'Warning' WHEN health_score >= 50 THEN 'Degraded' ELSE 'Critical' END AS status,
       created_at
FROM (SELECT *, greatest(0, least(100, 100 - (null_penalty + duplicate_penalty + violation_penalty + anomaly_penalty))) AS health_score,
             greatest(0, 100 - (null_penalty + violation_penalty)) AS quality_score, greatest(0, 100 - anomaly_penalty) AS anomaly_score,
             greatest(0, 100 - 100 * overall_drift_score) AS drift_score FROM reports_base) b
JOIN (SELECT dataset_id, version_number, created_at FROM versions_v) USING (dataset_id, version_number)"""

VIEWS["scorecards_v"] = """
SELECT *, CASE WHEN reliability_score >= 90 THEN 'excellent' WHEN reliability_score >= 75 THEN 'good' WHEN reliability_score >= 50 THEN 'warning' ELSE 'critical' END AS classification
FROM (SELECT *, greatest(0, least(100, 0.4 * health_score + 0.3 * quality_score + 0.2 * drift_score + 0.1 * anomaly_score)) AS reliability_score FROM reports_v)"""

VIEWS["catalog_v"] = """
SELECT *, CASE WHEN n LIKE '%id%' THEN 'IDENTIFIER'
     WHEN n LIKE '%email%' OR n LIKE '%phone%' OR n LIKE '%mobile%' OR n LIKE '%name%' OR n LIKE '%address%' OR n LIKE '%ip%' THEN 'PII'
     WHEN regexp_matches(n, 'revenue|amount|price|sales|cost|salary') THEN 'FINANCIAL'
     WHEN regexp_matches(n, 'country|city|state|zip|region|postal') THEN 'GEOGRAPHY'
     WHEN regexp_matches(n, 'date|time|created|updated|timestamp') THEN 'TEMPORAL' ELSE 'QUANTITY' END AS semantic_type,
   CASE WHEN n LIKE '%id%' THEN 'NONE' WHEN n LIKE '%email%' THEN 'EMAIL' WHEN n LIKE '%phone%' OR n LIKE '%mobile%' THEN 'PHONE'
     WHEN n LIKE '%name%' THEN 'NAME' WHEN n LIKE '%address%' THEN 'ADDRESS' WHEN n LIKE '%ip%' THEN 'IP' ELSE 'NONE' END AS pii_class
FROM (SELECT *, lower(column_name) AS n FROM schema_rows)"""

VIEWS["sensitivity_v"] = """
SELECT dataset_id, count(*) FILTER (WHERE semantic_type = 'PII') AS pii_columns,
       CASE WHEN bool_or(semantic_type = 'PII') THEN 'CONFIDENTIAL' ELSE 'PUBLIC' END AS sensitivity_level
FROM catalog_v GROUP BY dataset_id"""

VIEWS["contracts_v"] = """
SELECT dataset_no * 10 + s AS contract_id, dataset_id, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(s * 14 AS INTEGER)) AS created_at
FROM dataset_dim, (SELECT unnest([0, 1]) AS s)"""

VIEWS["contract_facts"] = """
SELECT r.dataset_id, r.version_number, count(*) AS n, count(customer_id) AS cust_n, count(DISTINCT customer_id) AS cust_d,
       count(order_id) AS id_n, count(DISTINCT order_id) AS id_d,
       count(*) - count(state_code) AS state_null,
       count(*) FILTER (WHERE NOT regexp_matches(state_code, '^(?:[FOP])')) AS state_bad,
       bool_or(TRY_CAST(total_price AS DOUBLE) < 1200) AS price_low, bool_or(TRY_CAST(total_price AS DOUBLE) > 9000000) AS price_high
FROM raw_orders r GROUP BY ALL"""

VIEWS["contract_violations_v"] = """
SELECT f.dataset_id, f.version_number, d.dataset_no * 10 + 1 AS contract_id, d.dataset_no * 100 + k AS rule_id, rule_type, column_name, severity, message FROM dataset_dim d JOIN (
  SELECT v.dataset_id, v.version_number, 1 AS k, 'column_exists' AS rule_type, 'customer_id' AS column_name, 'critical' AS severity,
         'Required column ''customer_id'' is missing from the schema.' AS message FROM versions_v v
   WHERE NOT EXISTS (SELECT 1 FROM schema_rows s WHERE s.dataset_id = v.dataset_id AND s.version_number = v.version_number AND s.column_name = 'customer_id')
  UNION ALL SELECT dataset_id, version_number, 2, 'column_type', 'total_price', 'high',
         'Column ''total_price'' inferred type ''FINANCIAL'' does not match expected ''QUANTITY''.' FROM catalog_v WHERE column_name = 'total_price'
  UNION ALL SELECT dataset_id, version_number, 3, 'max_null_pct', 'state_code', 'medium', printf('Column ''state_code'' null percentage %.2f%% exceeds threshold of %.2f%%.', a, 4.0::DOUBLE)
       FROM (SELECT *, state_null * 100.0::DOUBLE / n AS a FROM contract_facts) WHERE a > 4.0
  UNION ALL SELECT dataset_id, version_number, 4, 'uniqueness', 'order_id', 'high', printf('Column ''order_id'' uniqueness ratio %.2f%% is below expected threshold of %.2f%%.', a, 95.0::DOUBLE)
       FROM (SELECT *, id_d * 100.0::DOUBLE / id_n AS a FROM contract_facts) WHERE a < 95.0
  UNION ALL SELECT dataset_id, version_number, 5, 'regex', 'state_code', 'high', printf('Column ''state_code'' has %d values that do not match the expected pattern.', state_bad)
       FROM contract_facts WHERE state_bad > 0
  UNION ALL SELECT dataset_id, version_number, 6, 'range', 'total_price', 'low',
       CASE WHEN price_low THEN printf('Column ''total_price'' has values below minimum limit of %.2f.', 1200.0::DOUBLE)
            ELSE printf('Column ''total_price'' has values above maximum limit of %.2f.', 9000000.0::DOUBLE) END
       FROM contract_facts WHERE price_low OR price_high) f USING (dataset_id)"""

VIEWS["targets_v"] = "SELECT dataset_id, 24 AS target_hours, 60.0::DOUBLE + dataset_no * 3 AS target_quality FROM dataset_dim"

VIEWS["newest_v"] = """
SELECT v.dataset_id, v.version_number, v.created_at, r.health_score, r.quality_score, r.overall_drift_score
FROM (SELECT dataset_id, max(version_number) AS version_number, max_by(created_at, version_number) AS created_at FROM versions_v GROUP BY 1) v
LEFT JOIN reports_v r ON r.dataset_id = v.dataset_id AND r.version_number = v.version_number"""

VIEWS["sla_v"] = """
SELECT *, (CAST(freshness_met AS INTEGER) + CAST(quality_met AS INTEGER)) / 2.0::DOUBLE * 100 AS compliance_pct FROM (
  SELECT d.dataset_id, coalesce(n.created_at >= TIMESTAMP '2024-02-01' - to_hours(target_hours), false) AS freshness_met,
         coalesce(n.quality_score >= target_quality, false) AS quality_met
  FROM dataset_dim d LEFT JOIN newest_v n USING (dataset_id) LEFT JOIN targets_v t USING (dataset_id))"""

VIEWS["fresh_metrics_v"] = """
SELECT dataset_id, dataset_no, greatest(0, 100 - latest_delay)::DOUBLE AS freshness_score, latest_status IN ('late', 'critical') AS sla_breach,
       round(avg_delay, 2) AS average_delay_minutes, latest_status, latest_delay
FROM dataset_dim JOIN (SELECT dataset_no, max_by(delay_minutes, (actual_time, record_id)) AS latest_delay,
  max_by(status, (actual_time, record_id)) AS latest_status, avg(delay_minutes) AS avg_delay FROM freshness_v GROUP BY 1) USING (dataset_no)"""

VIEWS["policies_v"] = """
SELECT dataset_id, 'P' || k AS policy_id, category FROM dataset_dim,
  (VALUES (1, 'PII Compliance'), (2, 'Retention Policy'), (3, 'Freshness Policy'), (4, 'Schema Governance'), (5, 'Quality Standards')) p(k, category)
WHERE dataset_no <> 5 AND k <> dataset_no"""

VIEWS["judged_v"] = """
SELECT p.*, coalesce(CASE category WHEN 'PII Compliance' THEN s.pii_columns > 0 AND s.sensitivity_level = 'PUBLIC'
   WHEN 'Retention Policy' THEN (SELECT count(*) FROM versions_v v WHERE v.dataset_id = p.dataset_id) > 5
   WHEN 'Freshness Policy' THEN f.latest_status = 'critical'
   WHEN 'Schema Governance' THEN (SELECT count(*) FROM contract_violations_v c WHERE c.dataset_id = n.dataset_id AND c.version_number = n.version_number) > 0
   WHEN 'Quality Standards' THEN n.health_score < 80 END, false) AS failed
FROM policies_v p LEFT JOIN sensitivity_v s USING (dataset_id) LEFT JOIN fresh_metrics_v f USING (dataset_id) LEFT JOIN newest_v n USING (dataset_id)"""

VIEWS["compliance_v"] = """
SELECT d.dataset_id, coalesce(count(*) FILTER (WHERE NOT failed) * 100.0::DOUBLE / nullif(count(policy_id), 0), 100.0) AS compliance_score,
       coalesce(string_agg(policy_id, ',' ORDER BY policy_id) FILTER (WHERE failed), '') AS failed_policies,
       coalesce(string_agg(policy_id, ',' ORDER BY policy_id) FILTER (WHERE NOT failed), '') AS passed_policies
FROM dataset_dim d LEFT JOIN judged_v j USING (dataset_id) GROUP BY d.dataset_id"""

VIEWS["platform_v"] = """
SELECT *, 0.30 * quality_avg + 0.25 * health_avg + 0.20 * sla_compliance + 0.15 * freshness_score + 0.10 * stability AS platform_score FROM (
  SELECT *, greatest(0, 100.0::DOUBLE - 15 * critical_incidents - 5 * active_incidents) AS stability FROM (
    SELECT g.dataset_id, g.datasets_monitored, i.active_incidents, i.critical_incidents, r.quality_avg, r.health_avg, r.drift_avg, r.anomaly_avg, s.sla_compliance, f.freshness_score
    FROM (SELECT coalesce(dataset_id, 'ALL') AS dataset_id, count(*) AS datasets_monitored FROM dataset_dim GROUP BY ROLLUP (dataset_id)) g
    JOIN (SELECT coalesce(dataset_id, 'ALL') AS dataset_id, count(*) FILTER (WHERE status = 'OPEN') AS active_incidents,
            count(*) FILTER (WHERE status = 'OPEN' AND severity = 'critical') AS critical_incidents FROM incidents_v JOIN dataset_dim USING (dataset_no) GROUP BY ROLLUP (dataset_id)) i USING (dataset_id)
    JOIN (SELECT coalesce(dataset_id, 'ALL') AS dataset_id, avg(quality_score) AS quality_avg, avg(health_score) AS health_avg, avg(drift_score) AS drift_avg, avg(anomaly_score) AS anomaly_avg
          FROM reports_v GROUP BY ROLLUP (dataset_id)) r USING (dataset_id)
    JOIN (SELECT coalesce(dataset_id, 'ALL') AS dataset_id, avg(compliance_pct) AS sla_compliance FROM sla_v GROUP BY ROLLUP (dataset_id)) s USING (dataset_id)
    JOIN (SELECT coalesce(dataset_id, 'ALL') AS dataset_id, 100 - 100.0::DOUBLE * count(*) FILTER (WHERE status = 'critical') / count(*) AS freshness_score
          FROM freshness_v JOIN dataset_dim USING (dataset_no) GROUP BY ROLLUP (dataset_id)) f USING (dataset_id)))"""

VIEWS["intelligence_v"] = """
SELECT *, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 50 THEN 'Warning' ELSE 'Critical' END AS rating FROM (
  SELECT *, greatest(0, least(100, 0.25 * reliability + 0.20 * sla_compliance + 0.20 * governance_compliance + 0.15 * incident_stability + 0.10 * contract_compliance + 0.10 * workflow_success_rate)) AS score FROM (
    SELECT (SELECT platform_score FROM platform_v WHERE dataset_id = 'ALL') AS reliability, (SELECT avg(compliance_pct) FROM sla_v) AS sla_compliance,
           (SELECT avg(compliance_score) FROM compliance_v) AS governance_compliance,
           (SELECT greatest(0, 100.0::DOUBLE - 10 * count(*)) FROM incidents_v WHERE status = 'OPEN') AS incident_stability,
           (SELECT greatest(0, 100.0::DOUBLE - 10 * count(*)) FROM contract_violations_v) AS contract_compliance,
           (SELECT 100.0::DOUBLE * count(*) FILTER (WHERE event_type <> 'error') / count(*) FROM events) AS workflow_success_rate))"""

VIEWS["boards_v"] = """
SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY score DESC, dataset_id) AS BIGINT) AS rank FROM (
  SELECT dataset_id, unnest(['best_quality', 'best_health', 'lowest_drift', 'lowest_anomalies', 'most_improved', 'best_overall']) AS category,
         unnest([quality_score, health_score, drift_score, anomaly_score, health_score - first_health, reliability_score]) AS score
  FROM scorecards_v s JOIN (SELECT dataset_id, max(version_number) AS last_version, min_by(health_score, version_number) AS first_health FROM reports_v GROUP BY 1) f
    USING (dataset_id) WHERE s.version_number = f.last_version)"""

VIEWS["causes_v"] = """
SELECT dataset_id, version_number, 'quality' AS issue_type, root_cause, least(affected / 5.0::DOUBLE * 0.5 + weight / 4 * 0.5, 1) AS confidence, finding_count FROM (
  SELECT dataset_id, version_number, count(*) AS finding_count, count(DISTINCT column_name) AS affected,
         max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)::DOUBLE AS weight FROM violations_v GROUP BY ALL)
JOIN (SELECT dataset_id, version_number, cause AS root_cause FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset_id, version_number ORDER BY c DESC, cause) AS r FROM (
      SELECT dataset_id, version_number, cause, count(*) AS c FROM (
        SELECT *, CASE WHEN u LIKE '%NULL%' OR u LIKE '%MISSING%' THEN 'missing_data' WHEN u LIKE '%DUPLICATE%' THEN 'duplicate_records'
          WHEN u LIKE '%REGEX%' OR u LIKE '%FORMAT%' THEN 'schema_violations' WHEN u LIKE '%MIN%' OR u LIKE '%MAX%' THEN 'range_failures'
          WHEN u LIKE '%REFERENTIAL%' THEN 'referential_breaks' ELSE 'schema_violations' END AS cause FROM (SELECT *, upper(message) AS u FROM violations_v)) GROUP BY ALL)) WHERE r = 1)
  USING (dataset_id, version_number)
UNION ALL
SELECT dataset_id, version_number, 'anomaly', 'single_column_outlier', least(count(*) / 5.0::DOUBLE * 0.5 + 0.5, 1), CAST(sum(outlier_count) AS BIGINT)
FROM outliers_v WHERE outlier_count > 0 GROUP BY dataset_id, version_number
UNION ALL
SELECT dataset_id, version_number, 'drift', root_cause, least(affected / 5.0::DOUBLE * 0.5 + weight / 4 * 0.5, 1), finding_count FROM (
  SELECT dataset_id, version_number, count(*) AS finding_count, count(DISTINCT column_name) AS affected, max(CASE severity WHEN 'HIGH' THEN 4.0 ELSE 2.5 END)::DOUBLE AS weight
  FROM drift_v WHERE severity <> 'LOW' GROUP BY ALL)
JOIN (SELECT dataset_id, version_number, cause AS root_cause FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset_id, version_number ORDER BY c DESC, cause) AS r FROM (
      SELECT dataset_id, version_number, CASE drift_metric WHEN 'MEAN_SHIFT' THEN 'mean_shift' WHEN 'STD_SHIFT' THEN 'variance_shift' WHEN 'CARD_DRIFT' THEN 'cardinality_shift' ELSE 'distribution_shift' END AS cause, count(*) AS c
      FROM drift_v WHERE severity <> 'LOW' GROUP BY ALL)) WHERE r = 1) USING (dataset_id, version_number)"""

VIEWS["recs_v"] = """
SELECT * EXCLUDE (message), 'Title: ' || title || chr(10) || 'Why: ' || why || chr(10) || 'Evidence: ' || evidence || coalesce(message, '') AS description FROM (
SELECT dataset_id, version_number, 'QUALITY_REMEDIATION' AS recommendation_type, severity AS priority, 'Resolve Quality Failure in ' || coalesce(column_name, 'dataset') AS title,
       'This recommendation was generated because the quality check failed.' AS why,
       'Rule failed on column ''' || coalesce(column_name, 'None') || '''. Actual value: ' || coalesce(printf('%.4f', actual_value), 'None') || '. Expected threshold: ' || coalesce(printf('%.4f', expected_value), 'None') || '.' AS evidence,
       chr(10) || 'Message: ' || message AS message
FROM violations_v WHERE severity IN ('high', 'critical')
UNION ALL
SELECT dataset_id, version_number, 'ANOMALY_INVESTIGATION', CASE WHEN outlier_count > 5 THEN 'high' ELSE 'medium' END, 'Investigate Outliers in Column ' || column_name,
       'Generated due to a high density of outlier points detected in ''' || column_name || '''.',
       printf('Detected %d anomaly points using algorithm iqr.', outlier_count), NULL FROM outliers_v WHERE outlier_count > 0
UNION ALL
SELECT dataset_id, version_number, 'DRIFT_REVIEW', CASE severity WHEN 'HIGH' THEN 'high' ELSE 'medium' END, 'Review Drift in Column ' || column_name,
       'Generated due to significant data drift detected compared to baseline.',
       printf('Metric ''%s'' score is %.4f (Severity: %s).', drift_metric, drift_score, severity), NULL FROM drift_v WHERE severity <> 'LOW')"""

VIEWS["triggers_v"] = """
SELECT dataset_id, version_number, 'critical' AS severity, 'Critical Dataset Health Score Breach' AS title,
       printf('Dataset health score dropped to %.2f, breaching the threshold limit.', health_score) AS description FROM reports_v WHERE health_score < 50
UNION ALL
SELECT dataset_id, version_number, 'high', 'Critical Quality Validation Violations', printf('Detected %d critical validation checks failing in quality execution run.', count(*))
FROM violations_v WHERE severity = 'critical' GROUP BY dataset_id, version_number
UNION ALL
SELECT dataset_id, version_number, 'medium', 'Excessive Outliers Detected', printf('Outlier validation run detected a high density of %d anomalous points.', anomaly_count) FROM reports_v WHERE anomaly_count > 10"""

VIEWS["reach_v"] = """
SELECT src AS root, dst AS node FROM edges_v UNION SELECT reach_v.root, e.dst FROM reach_v JOIN edges_v e ON e.src = reach_v.node"""
