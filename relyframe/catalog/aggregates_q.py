"""D: aggregations, from single counts to the full column profile."""

from pyspark.sql import functions as F

from relyframe.catalog.registry import query, r4
from relyframe.operators import drift, profile, relational
from relyframe.plans import reports
from relyframe.session import with_broadcast
from relyframe.sources import inputs
from relyframe.sources.tables import table

K = inputs.KEYS


@query("d01_row_column_count", "SELECT dataset_id, version_number, row_count, column_count FROM summary_v")
def row_column_count(spark, root):
    d = inputs.dirty_orders(spark, root)
    n = len(profile.value_columns(d, K))
    return d.groupBy(*K).agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(n))


@query("d02_duplicate_rows", "SELECT dataset_id, version_number, row_count, duplicate_rows_count, round(duplicate_rows_percent, 4) AS duplicate_rows_percent FROM summary_v")
def duplicate_rows(spark, root):
    s = profile.table_summary(inputs.dirty_orders(spark, root), K)
    return r4(s.select(*K, "row_count", "duplicate_rows_count", "duplicate_rows_percent"))


@query(
    "d02_duplicate_lines",
    """SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicate_rows_count FROM lineitem""",
)
def duplicate_lines(spark, root):
    li = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber")
    return profile.table_summary(li, []).select("row_count", "duplicate_rows_count")


@query("d03_missing_cells", "SELECT dataset_id, version_number, total_cells, missing_cells_count, round(missing_cells_percent, 4) AS missing_cells_percent FROM summary_v")
def missing_cells(spark, root):
    d = profile.nan_to_null(inputs.dirty_orders(spark, root))
    cols = profile.value_columns(d, K)
    total = F.count(F.lit(1)) * len(cols)
    missing = sum((F.count_if(F.col(c).isNull()) for c in cols[1:]), F.count_if(F.col(cols[0]).isNull()))
    out = d.groupBy(*K).agg(total.alias("total_cells"), missing.alias("missing_cells_count"))
    return r4(out.withColumn("missing_cells_percent", profile.percent(F.col("missing_cells_count"), F.col("total_cells"))))


@query("d04_column_nulls", "SELECT dataset_id, version_number, column_name, missing_count, round(missing_percent, 4) AS missing_percent FROM col_counts")
def column_nulls(spark, root):
    return r4(profile.column_stats(inputs.dirty_orders(spark, root), K).select(*K, "column_name", "missing_count", "missing_percent"))


@query("d05_distinct_count", "SELECT dataset_id, version_number, column_name, unique_count, round(unique_percent, 4) AS unique_percent FROM col_counts")
def distinct_count(spark, root):
    d = inputs.dirty_orders(spark, root)
    rows = d.groupBy(*K).agg(F.count(F.lit(1)).alias("row_count"))
    u = profile.distinct_counts(d, K, profile.value_columns(d, K)).join(rows, K)
    return r4(u.select(*K, "column_name", "unique_count", profile.percent(F.col("unique_count"), F.col("row_count")).alias("unique_percent")))


@query(
    "d06_min_max_mean_std",
    """SELECT dataset_id, version_number, column_name, round(min, 4) AS min, round(max, 4) AS max, round(mean, 4) AS mean, round(std, 4) AS std FROM fences_v""",
)
def min_max_mean_std(spark, root):
    st = profile.column_stats(inputs.dirty_orders(spark, root), K).where("is_numeric")
    return r4(st.select(*K, "column_name", "min", "max", "mean", "std"))


@query(
    "d07_quartiles",
    "SELECT dataset_id, version_number, column_name, round(p25, 4) AS p25, round(median, 4) AS median, round(p75, 4) AS p75 FROM fences_v",
)
def quartiles(spark, root):
    d = inputs.dirty_orders(spark, root)
    return r4(profile.iqr_bounds(d, K, profile.numeric_columns(d, K)).select(*K, "column_name", "p25", "median", "p75"))


@query(
    "d07_line_quartiles",
    """SELECT column_name, count(*) AS n, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS p75
       FROM (SELECT unnest(['l_orderkey','l_partkey','l_suppkey','l_linenumber','l_quantity','l_extendedprice','l_discount','l_tax']) AS column_name,
                    unnest([l_orderkey::DOUBLE, l_partkey::DOUBLE, l_suppkey::DOUBLE, l_linenumber::DOUBLE, l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem) GROUP BY 1""",
)
def line_quartiles(spark, root):
    """Whole-table groups: every numeric column is one group."""
    from relyframe.operators.quantiles import exact_quantiles

    lines = table(spark, root, "lineitem")
    rows = profile.long_numbers(lines, [], profile.numeric_columns(lines, []))
    q = exact_quantiles(rows, ["column_name"], "value", [0.25, 0.5, 0.75])
    return r4(q.select("column_name", "n", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("p25", "median", "p75"))]))


@query(
    "d07_null_key_groups",
    """SELECT nullif(o_orderpriority, '2-HIGH') AS dataset_id, count(*) AS n, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
              round(quantile_cont(o_totalprice, 0.75), 4) AS p75 FROM orders GROUP BY 1""",
)
def null_key_quartiles(spark, root):
    """Rows without a dataset are a group of their own."""
    from relyframe.operators.quantiles import exact_quantiles

    o = table(spark, root, "orders").select(F.nullif("o_orderpriority", F.lit("2-HIGH")).alias("dataset_id"), "o_totalprice")
    q = exact_quantiles(o, ["dataset_id"], "o_totalprice", [0.25, 0.5, 0.75])
    return r4(q.select("dataset_id", "n", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("p25", "median", "p75"))]))


@query("d08_iqr_outlier_count", "SELECT dataset_id, version_number, column_name, outlier_count FROM outliers_v")
def iqr_outlier_count(spark, root):
    d = inputs.dirty_orders(spark, root)
    return profile.outlier_counts(d, K, profile.numeric_columns(d, K)).select(*K, "column_name", "outlier_count")


@query("d09_top_values", "SELECT dataset_id, version_number, column_name, value, cnt, rank FROM tops_v")
def top_values(spark, root):
    d = inputs.dirty_orders(spark, root)
    return profile.top_values(profile.value_counts(d, K, ["o_orderstatus", "o_orderdate"]), K)


@query("d10_value_shares", "SELECT dataset_id, version_number, column_name, value, round(p, 4) AS share FROM shares_v")
def value_shares(spark, root):
    counts = profile.value_counts(inputs.dirty_orders(spark, root), K, ["o_orderstatus", "o_orderdate"])
    return r4(relational.share_of_total(counts, [*K, "column_name"], "cnt").select(*K, "column_name", "value", "share"))


@query("d11_group_count", "SELECT column_name, CAST(sum(outlier_count) AS BIGINT) AS anomalies FROM outliers_v GROUP BY 1")
def group_count(spark, root):
    return reports.anomaly_facts(spark, root).groupBy("column_name").agg(F.sum("anomaly_count").alias("anomalies"))


@query(
    "d12_top_groups",
    """SELECT coalesce(column_name, 'OVERALL') AS column_name, count(*) AS violation_count FROM violations_v GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def top_groups(spark, root):
    name = F.coalesce(F.nullif("column_name", F.lit("")), F.lit("OVERALL"))
    v = reports.violation_facts(spark, root).groupBy(name.alias("column_name")).agg(F.count(F.lit(1)).alias("violation_count"))
    return v.orderBy(F.desc("violation_count"), "column_name").limit(10)


@query(
    "d13_conditional_counts",
    """SELECT count(*) FILTER (WHERE status = 'OPEN') AS total_active, count(*) FILTER (WHERE status = 'INVESTIGATING') AS investigating,
              count(*) FILTER (WHERE status = 'RESOLVED') AS resolved, count(*) FILTER (WHERE status = 'OPEN' AND severity = 'critical') AS critical FROM incidents_v""",
)
def conditional_counts(spark, root):
    s = F.col("status")
    return inputs.incidents(spark, root).agg(
        F.count_if(s == "OPEN").alias("total_active"),
        F.count_if(s == "INVESTIGATING").alias("investigating"),
        F.count_if(s == "RESOLVED").alias("resolved"),
        F.count_if((s == "OPEN") & (F.col("severity") == "critical")).alias("critical"),
    )


@query(
    "d14_rounded_averages",
    """SELECT coalesce(round(avg(health_score), 2), 100.0) AS average_health_score, coalesce(round(avg(quality_score), 2), 100.0) AS average_quality_score,
              coalesce(round(avg(anomaly_score), 2), 100.0) AS average_anomaly_score, coalesce(round(avg(drift_score), 2), 100.0) AS average_drift_score FROM reports_v""",
)
def rounded_averages(spark, root):
    names = ["health", "quality", "anomaly", "drift"]
    return reports.reports(spark, root).agg(
        *[F.coalesce(F.round(F.avg(f"{n}_score"), 2), F.lit(100.0)).alias(f"average_{n}_score") for n in names]
    )


@query(
    "d15_average_of_latest",
    "SELECT round(avg(s), 4) AS average_score, count(*) AS datasets FROM (SELECT dataset_id, max_by(health_score, created_at) AS s FROM reports_v GROUP BY 1)",
)
def average_of_latest(spark, root):
    last = reports.reports(spark, root).groupBy("dataset_id").agg(F.max_by("health_score", "created_at").alias("s"))
    return r4(last.agg(F.avg("s").alias("average_score"), F.count(F.lit(1)).alias("datasets")))


@query(
    "d16_cost_sums",
    """SELECT round(c, 4) AS compute, round(s, 4) AS storage, round(c + s, 4) AS total FROM
       (SELECT sum(value * 0.0001::DOUBLE) AS c FROM events), (SELECT sum(n_chars) * 0.000001::DOUBLE AS s FROM documents)""",
)
def cost_sums(spark, root):
    """Event values stand for CPU milliseconds, document sizes for stored bytes."""
    from relyframe.plans.insight import cost_rollup

    cpu = table(spark, root, "events").select(F.col("value").alias("cpu_ms"))
    stored = table(spark, root, "documents").select((F.col("n_chars") * 0.000001).alias("monthly_cost"))
    return r4(cost_rollup(cpu, stored))


@query(
    "d17_mode",
    """SELECT o_custkey, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS r
       FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)) WHERE r = 1""",
)
def mode(spark, root):
    return relational.most_common(table(spark, root, "orders"), ["o_custkey"], "o_orderpriority").withColumnRenamed("cnt", "n")


@query(
    "d18_max_weight",
    """SELECT dataset_no, max(CASE severity WHEN 'critical' THEN 4.0 WHEN 'high' THEN 3.0 WHEN 'medium' THEN 2.0 ELSE 1.0 END)::DOUBLE AS max_weight FROM incidents_v GROUP BY 1""",
)
def max_weight(spark, root):
    from relyframe.functions.scores import lookup
    from relyframe.plans.insight import SEVERITY_WEIGHTS

    w = lookup(F.col("severity"), SEVERITY_WEIGHTS, 1.0)
    return inputs.incidents(spark, root).groupBy("dataset_no").agg(F.max(w).alias("max_weight"))


@query(
    "d19_any_all",
    """SELECT dataset_id, version_number, bool_and(regexp_matches(o_orderstatus, '^(?:[FO])')) AS all_match, bool_or(o_totalprice < 1100) AS any_below,
              bool_or(o_totalprice > 9000000) AS any_above FROM dirty_orders GROUP BY ALL""",
)
def any_all(spark, root):
    return inputs.dirty_orders(spark, root).groupBy(*K).agg(
        F.bool_and(F.col("o_orderstatus").rlike("^(?:[FO])")).alias("all_match"),
        F.bool_or(F.col("o_totalprice") < 1100).alias("any_below"),
        F.bool_or(F.col("o_totalprice") > 9000000).alias("any_above"),
    )


@query(
    "d20_collect_set",
    "SELECT dataset_id, version_number, string_agg(column_name, ',' ORDER BY column_name) AS affected FROM (SELECT DISTINCT dataset_id, version_number, column_name FROM violations_v WHERE column_name IS NOT NULL) GROUP BY ALL",
)
def collect_set(spark, root):
    """Bounded by the number of columns a rule can name."""
    v = reports.violation_facts(spark, root).where("column_name IS NOT NULL")
    return v.groupBy(*K).agg(F.array_join(F.sort_array(F.collect_set("column_name")), ",").alias("affected"))


@query(
    "d21_success_ratio",
    """SELECT user_id, round(coalesce(count(*) FILTER (WHERE event_type <> 'error') * 100.0::DOUBLE / nullif(count(*), 0), 100.0), 4) AS success_rate FROM events GROUP BY 1""",
)
def success_ratio(spark, root):
    e = table(spark, root, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") != "error").alias("ok"), F.count(F.lit(1)).alias("n")
    )
    return r4(e.select("user_id", F.coalesce(F.try_divide(F.col("ok") * 100.0, "n"), F.lit(100.0)).alias("success_rate")))


@query(
    "d22_histogram",
    "SELECT dataset_id, version_number, column_name, bin - 1 AS bin, CAST(c AS BIGINT) AS cnt FROM psi_hist",
)
def fixed_edge_histogram(spark, root):
    d = inputs.dirty_orders(spark, root)
    by = ["dataset_id", "column_name"]
    rows = profile.long_numbers(d, K, profile.numeric_columns(d, K))
    edges = with_broadcast(drift.bin_edges(rows.where("version_number = 1"), by))
    h = drift.histogram(rows, edges, by, [*K, "column_name"])
    return h.select(*K, "column_name", F.posexplode("counts").alias("bin", "cnt"))


@query(
    "d23_full_profile",
    """SELECT dataset_id, version_number, column_name, is_numeric, row_count, missing_count, round(missing_percent, 4) AS missing_percent, unique_count,
              round(unique_percent, 4) AS unique_percent, round(min, 4) AS min, round(max, 4) AS max, round(mean, 4) AS mean, round(median, 4) AS median,
              round(std, 4) AS std, round(p25, 4) AS p25, round(p75, 4) AS p75, coalesce(outlier_count, 0) AS outlier_count, top_values FROM profiles_v""",
)
def full_profile(spark, root):
    return r4(profile.profile(inputs.dirty_orders(spark, root), K).na.fill({"outlier_count": 0}))


@query(
    "d23_lineitem_profile",
    """WITH cells AS (SELECT unnest(['l_orderkey','l_partkey','l_suppkey','l_linenumber','l_quantity','l_extendedprice','l_discount','l_tax']) AS column_name,
                             unnest([l_orderkey::DOUBLE, l_partkey::DOUBLE, l_suppkey::DOUBLE, l_linenumber::DOUBLE, l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem),
       st AS (SELECT column_name, count(*) AS row_count, count(DISTINCT v) AS unique_count, min(v) AS min, max(v) AS max, avg(v) AS mean, quantile_cont(v, 0.5) AS median,
                     stddev_samp(v) AS std, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75 FROM cells GROUP BY 1),
       oc AS (SELECT column_name, count(*) FILTER (WHERE v < p25 - 1.5 * (p75 - p25) OR v > p75 + 1.5 * (p75 - p25)) AS outlier_count FROM cells JOIN st USING (column_name) GROUP BY 1)
       SELECT column_name, row_count, unique_count, round(min, 4) AS min, round(max, 4) AS max, round(mean, 4) AS mean, round(median, 4) AS median, round(std, 4) AS std,
              round(p25, 4) AS p25, round(p75, 4) AS p75, outlier_count FROM st JOIN oc USING (column_name)""",
)
def lineitem_profile(spark, root):
    li = table(spark, root, "lineitem")
    li = li.select(*profile.numeric_columns(li, []))
    return r4(
        profile.profile(li, []).select(
            "column_name", "row_count", "unique_count", "min", "max", "mean", "median", "std", "p25", "p75", "outlier_count"
        )
    )


@query(
    "d24_affected_columns",
    "SELECT dataset_id, version_number, count(DISTINCT column_name) AS affected_columns FROM violations_v WHERE coalesce(column_name, '') <> '' GROUP BY ALL",
)
def affected_columns(spark, root):
    v = reports.violation_facts(spark, root).where("coalesce(column_name, '') <> ''")
    return v.groupBy(*K).agg(F.count_distinct("column_name").alias("affected_columns"))
