"""B: projections, filters and predicates."""

from pyspark.sql import functions as F

from relyframe.catalog.registry import query, r4
from relyframe.operators import profile, relational
from relyframe.plans import reports
from relyframe.sources import inputs
from relyframe.sources.tables import table

K = inputs.KEYS


@query("b01_projection", "SELECT o_orderkey AS id, o_custkey AS customer, round(o_totalprice, 4) AS amount, CAST(o_orderdate AS VARCHAR) AS placed_at FROM orders")
def projection(spark, root):
    return r4(
        table(spark, root, "orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("customer"),
            F.col("o_totalprice").alias("amount"),
            F.col("o_orderdate").alias("placed_at"),
        )
    )


@query("b02_conjunctive_filter", "SELECT incident_id, dataset_no, version_number FROM incidents_v WHERE status = 'OPEN' AND severity = 'critical'")
def conjunctive_filter(spark, root):
    i = inputs.incidents(spark, root)
    return i.where((F.col("status") == "OPEN") & (F.col("severity") == "critical")).select("incident_id", "dataset_no", "version_number")


@query("b03_in_list", "SELECT incident_id, severity FROM incidents_v WHERE severity IN ('critical', 'high')")
def in_list(spark, root):
    return inputs.incidents(spark, root).where(F.col("severity").isin("critical", "high")).select("incident_id", "severity")


@query(
    "b04_time_range",
    "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 30 DAY",
)
def time_range(spark, root):
    as_of, days = F.lit("2001-08-01 00:00:00").cast("timestamp_ntz"), 30
    o = table(spark, root, "orders").where(F.col("o_orderdate") < as_of - F.make_dt_interval(days=F.lit(days)))
    return r4(o.select("o_orderkey", "o_orderdate"))


@query("b05_null_filter", "SELECT dataset_id, version_number, count(*) AS kept FROM dirty_orders WHERE o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY ALL")
def null_filter(spark, root):
    d = profile.nan_to_null(inputs.dirty_orders(spark, root)).where("o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL")
    return d.groupBy(*K).agg(F.count(F.lit(1)).alias("kept"))


@query(
    "b06_numeric_columns",
    """SELECT column_name, count(*) AS filled, round(avg(v), 4) AS mean FROM (
       SELECT unnest(['l_orderkey','l_partkey','l_suppkey','l_linenumber','l_quantity','l_extendedprice','l_discount','l_tax']) AS column_name,
              unnest([l_orderkey::DOUBLE, l_partkey::DOUBLE, l_suppkey::DOUBLE, l_linenumber::DOUBLE, l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem)
       GROUP BY column_name""",
)
def numeric_column_selection(spark, root):
    li = table(spark, root, "lineitem")
    st = profile.column_stats(li.select(*relational.numeric_names(li)), [])
    return r4(st.select("column_name", (F.col("row_count") - F.col("missing_count")).alias("filled"), "mean"))


@query(
    "b07_common_columns",
    """SELECT a.dataset_id, a.version_number, a.column_name FROM schema_rows a
       JOIN schema_rows b ON a.dataset_id = b.dataset_id AND a.column_name = b.column_name AND b.version_number = 1 WHERE a.version_number > 1""",
)
def common_columns(spark, root):
    from relyframe.operators import schema

    rows = schema.infer_types(inputs.raw_orders(spark, root), K)
    first = rows.where("version_number = 1").select("dataset_id", "column_name")
    return rows.where("version_number > 1").join(first, ["dataset_id", "column_name"], "left_semi").select(*K, "column_name")


@query(
    "b08_any_column_search",
    """SELECT * REPLACE (round(p_retailprice, 4) AS p_retailprice) FROM part
       WHERE lower(p_partkey::VARCHAR) LIKE '%ring%' OR lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%' OR lower(p_type) LIKE '%ring%' OR lower(p_size::VARCHAR) LIKE '%ring%'
             OR lower(p_retailprice::VARCHAR) LIKE '%ring%'""",
)
def any_column_search(spark, root):
    return r4(relational.search_any_column(table(spark, root, "part"), "RING"))


@query(
    "b09_dynamic_predicate",
    """SELECT event_id, op, round(value, 4) AS value FROM (SELECT *, ['>', '<', '>=', '<=', '==', '!~'][CAST(user_id % 6 + 1 AS BIGINT)] AS op FROM events)
       WHERE CASE op WHEN '>' THEN value > 50 WHEN '<' THEN value < 50 WHEN '>=' THEN value >= 50 WHEN '<=' THEN value <= 50 WHEN '==' THEN value = 50 ELSE false END""",
)
def dynamic_predicate(spark, root):
    ops = F.array(*[F.lit(o) for o in (">", "<", ">=", "<=", "==", "!~")])
    e = table(spark, root, "events").withColumn("op", F.element_at(ops, (F.col("user_id") % 6 + 1).cast("int")))
    return r4(e.where(relational.compare(F.col("value"), F.col("op"), F.lit(50.0))).select("event_id", "op", "value"))


@query(
    "b10_null_default",
    """SELECT coalesce(nullif(o_orderstatus, ''), 'OVERALL') AS status, round(coalesce(avg(coalesce(o_totalprice, 100.0)), 100.0), 4) AS average
       FROM dirty_orders GROUP BY 1""",
)
def null_default(spark, root):
    d = inputs.dirty_orders(spark, root)
    status = F.coalesce(F.nullif("o_orderstatus", F.lit("")), F.lit("OVERALL"))
    return r4(
        d.groupBy(status.alias("status")).agg(
            F.coalesce(F.avg(F.coalesce("o_totalprice", F.lit(100.0))), F.lit(100.0)).alias("average")
        )
    )


@query("b11_paging", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey OFFSET 20 LIMIT 100")
def paging(spark, root):
    return relational.page(table(spark, root, "customer").select("c_custkey", "c_name"), ["c_custkey"], 20, 100)


@query(
    "b12_median_imputation",
    """SELECT d.dataset_id, d.version_number, o_orderkey, round(coalesce(o_totalprice, m, 0), 4) AS o_totalprice FROM dirty_orders d
       LEFT JOIN (SELECT dataset_id, version_number, quantile_cont(o_totalprice, 0.5) AS m FROM dirty_orders GROUP BY ALL) USING (dataset_id, version_number)""",
)
def median_imputation(spark, root):
    d = inputs.dirty_orders(spark, root).select(*K, "o_orderkey", "o_totalprice")
    return r4(profile.impute_median(d, K, ["o_totalprice"]).select(*K, "o_orderkey", "o_totalprice"))


@query(
    "b13_enabled_rules",
    """SELECT dataset_id, version_number, 8 AS rules_enabled, 10 AS rules_total FROM (SELECT DISTINCT dataset_id, version_number FROM dirty_orders)""",
)
def enabled_rules(spark, root):
    from relyframe.operators import quality

    groups = inputs.dirty_orders(spark, root).select(*K).distinct()
    return quality.each_rule(groups, reports.RULES).groupBy(*K).agg(
        F.count_if("enabled").cast("int").alias("rules_enabled"), F.count(F.lit(1)).cast("int").alias("rules_total")
    )
