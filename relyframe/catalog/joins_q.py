"""C: joins between facts, dimensions, rules and versions."""

from pyspark.sql import functions as F

from relyframe.catalog.registry import query, r4
from relyframe.operators import drift, profile, relational, schema
from relyframe.operators.quantiles import previous_in_groups
from relyframe.plans import reports
from relyframe.session import with_broadcast
from relyframe.sources import inputs
from relyframe.sources.tables import table

K = inputs.KEYS


@query(
    "c01_join_grouped_subquery",
    """SELECT o.o_custkey, o.o_orderkey, round(o.o_totalprice, 4) AS o_totalprice FROM orders o
       JOIN (SELECT o_custkey, max(o_orderdate) AS last_date FROM orders GROUP BY 1) m ON m.o_custkey = o.o_custkey AND m.last_date = o.o_orderdate""",
)
def join_grouped_subquery(spark, root):
    o = table(spark, root, "orders")
    last = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate"))
    return r4(o.join(last, ["o_custkey", "o_orderdate"]).select("o_custkey", "o_orderkey", "o_totalprice"))


@query(
    "c02_filtered_join",
    """SELECT l_orderkey, l_linenumber, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       WHERE o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP '1996-01-01'""",
)
def filtered_join(spark, root):
    o = table(spark, root, "orders").where(
        (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    )
    li = table(spark, root, "lineitem")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey")


@query(
    "c03_left_join_default",
    """SELECT e.src, e.dst, e.relationship, coalesce(s_name, 'Unknown') AS dataset_name FROM edges_v e
       LEFT JOIN supplier ON s_suppkey = e.dst""",
)
def left_join_default(spark, root):
    """Names come from the supplier table, which does not have all keys."""
    named = table(spark, root, "supplier").select(F.col("s_suppkey").alias("dst"), "s_name")
    return inputs.edges(spark, root).join(named, "dst", "left").select(
        "src", "dst", "relationship", F.coalesce("s_name", F.lit("Unknown")).alias("dataset_name")
    )


@query(
    "c04_latest_child",
    """SELECT c_custkey, c_name, o_orderkey AS latest_order, CAST(o_orderdate AS VARCHAR) AS latest_date FROM customer LEFT JOIN
       (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1)
       ON o_custkey = c_custkey""",
)
def latest_child(spark, root):
    last = (
        table(spark, root, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
        .select("c_custkey", F.col("m.o_orderkey").alias("latest_order"), F.col("m.o_orderdate").alias("latest_date"))
    )
    c = table(spark, root, "customer").select("c_custkey", "c_name")
    return r4(c.join(last, "c_custkey", "left"))


@query(
    "c05_multi_table_enrichment",
    """SELECT d.dataset_id, d.dataset_name, v.version_number, round(r.health_score, 4) AS health_score, s.classification FROM dataset_dim d
       JOIN (SELECT dataset_id, max(version_number) AS version_number FROM versions_v GROUP BY 1) v USING (dataset_id)
       JOIN reports_v r ON r.dataset_id = d.dataset_id AND r.version_number = v.version_number
       LEFT JOIN (SELECT * FROM scorecards_v WHERE health_score < 60) s ON s.dataset_id = d.dataset_id AND s.version_number = v.version_number""",
)
def multi_table_enrichment(spark, root):
    newest = inputs.versions(spark, root).groupBy("dataset_id").agg(F.max("version_number").alias("version_number"))
    cards = reports.scorecards(spark, root).where("health_score < 60").select(*K, "classification")
    return r4(
        inputs.datasets(spark, root)
        .join(newest, "dataset_id")
        .join(reports.reports(spark, root).select(*K, "health_score"), K)
        .join(cards, K, "left")
        .select("dataset_id", "dataset_name", "version_number", "health_score", "classification")
    )


@query("c06_semi_join", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join(spark, root):
    done = table(spark, root, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, root, "lineitem").join(done, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("c07_missing_keys", "SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_keys(spark, root):
    have = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, root, "orders").select("o_orderkey").distinct().join(have, "o_orderkey", "left_anti")


@query(
    "c08_full_outer_on_value",
    """WITH sh AS (SELECT dataset_id, version_number, strftime(o_orderdate, '%m-%d') AS value,
                  count(*) / sum(count(*)) OVER (PARTITION BY dataset_id, version_number) AS p FROM dirty_orders GROUP BY 1, 2, 3)
       SELECT coalesce(a.dataset_id, b.dataset_id) AS dataset_id, coalesce(a.version_number, b.version_number) AS version_number, coalesce(a.value, b.value) AS value,
              round(coalesce(a.p, 0), 4) AS share, round(coalesce(b.p, 0), 4) AS next_share
       FROM (SELECT * FROM sh WHERE version_number < 7) a
       FULL JOIN (SELECT dataset_id, version_number - 1 AS version_number, value, p FROM sh WHERE version_number > 1) b
         ON a.dataset_id = b.dataset_id AND a.version_number = b.version_number AND a.value = b.value""",
)
def full_outer_on_value(spark, root):
    """Calendar-day shares of each version next to those of the following one, a missing day counting as 0."""
    day = F.date_format("o_orderdate", "MM-dd").alias("value")
    counts = inputs.dirty_orders(spark, root).groupBy(*K, day).agg(F.count(F.lit(1)).alias("n"))
    share = relational.share_of_total(counts, K, "n")
    mine = share.where(F.col("version_number") < inputs.LAST_VERSION).select(*K, "value", "share")
    after = share.where("version_number > 1").select(
        "dataset_id", (F.col("version_number") - 1).alias("version_number"), "value", F.col("share").alias("next_share")
    )
    return r4(mine.join(after, [*K, "value"], "full").na.fill(0.0, ["share", "next_share"]))


@query(
    "c09_full_outer_on_column",
    """SELECT a.dataset_id, coalesce(a.column_name, b.column_name) AS column_name, a.data_type AS old_type, b.data_type AS new_type,
              CASE WHEN a.data_type IS NULL THEN 'added' WHEN b.data_type IS NULL THEN 'removed' WHEN a.data_type <> b.data_type THEN 'retyped' ELSE 'same' END AS state
       FROM (SELECT * FROM schema_rows WHERE version_number = 1) a FULL JOIN (SELECT * FROM schema_rows WHERE version_number = 7) b
         ON a.dataset_id = b.dataset_id AND a.column_name = b.column_name WHERE a.dataset_id IS NOT NULL
       UNION ALL
       SELECT b.dataset_id, b.column_name, NULL, b.data_type, 'added' FROM (SELECT * FROM schema_rows WHERE version_number = 7) b
       WHERE NOT EXISTS (SELECT 1 FROM schema_rows a WHERE a.version_number = 1 AND a.dataset_id = b.dataset_id AND a.column_name = b.column_name)""",
)
def full_outer_on_column(spark, root):
    rows = schema.infer_types(inputs.raw_orders(spark, root), K)
    on = ["dataset_id", "column_name"]
    old = rows.where("version_number = 1").select(*on, F.col("data_type").alias("old_type"))
    new = rows.where("version_number = 7").select(*on, F.col("data_type").alias("new_type"))
    o, n = F.col("old_type"), F.col("new_type")
    state = F.when(o.isNull(), "added").when(n.isNull(), "removed").when(o != n, "retyped").otherwise("same")
    return old.join(new, on, "full").withColumn("state", state)


_METRICS = ["health_score", "quality_score", "drift_score", "anomaly_score"]
METRIC_RULES = [
    (1, "health_score", "<", 60.0),
    (2, "quality_score", "<=", 75.0),
    (3, "drift_score", ">", 76.0),
    (4, "anomaly_score", "==", 100.0),
    (5, "anomaly_score", "??", 1.0),
    (6, "unknown", ">", 0.0),
]


@query(
    "c10_rule_metric_join",
    """SELECT rule_id, dataset_id, version_number, metric, round(value, 4) AS value FROM
       (SELECT dataset_id, version_number, unnest(['health_score', 'quality_score', 'drift_score', 'anomaly_score']) AS metric,
               unnest([health_score, quality_score, drift_score, anomaly_score]) AS value FROM reports_v)
       JOIN (VALUES (1, 'health_score', '<', 60.0), (2, 'quality_score', '<=', 75.0), (3, 'drift_score', '>', 76.0), (4, 'anomaly_score', '==', 100.0),
                    (5, 'anomaly_score', '??', 1.0), (6, 'unknown', '>', 0.0)) r(rule_id, metric, op, threshold) USING (metric)
       WHERE CASE op WHEN '<' THEN value < threshold WHEN '<=' THEN value <= threshold WHEN '>' THEN value > threshold WHEN '>=' THEN value >= threshold WHEN '==' THEN value = threshold ELSE false END""",
)
def rule_metric_join(spark, root):
    long = reports.reports(spark, root).select(*K, *_METRICS).unpivot(K, _METRICS, "metric", "value")
    rules = F.broadcast(spark.createDataFrame(METRIC_RULES, "rule_id int, metric string, op string, threshold double"))
    hit = relational.compare(F.col("value"), F.col("op"), F.col("threshold"))
    return r4(long.join(rules, "metric").where(hit).select("rule_id", *K, "metric", "value"))


@query(
    "c11_baseline_join",
    """SELECT dataset_id, CAST(coalesce(explicit_v, registered_v, first_v) AS INTEGER) AS baseline_version FROM
       (SELECT dataset_id, min(version_number) AS first_v,
               max(CASE WHEN dataset_id LIKE '1-%' THEN 4 END) AS explicit_v,
               max(CASE WHEN row_count = mx AND dataset_id NOT LIKE '5-%' THEN version_number END) AS registered_v
        FROM (SELECT *, max(row_count) OVER (PARTITION BY dataset_id) AS mx FROM versions_v) GROUP BY dataset_id)""",
)
def baseline_join(spark, root):
    """Registered: the largest version (none for dataset 5). Asked for: version 4 of dataset 1."""
    v = inputs.versions(spark, root)
    registered = (
        v.where("dataset_id NOT LIKE '5-%'")
        .groupBy("dataset_id")
        .agg(F.max(F.struct("row_count", "version_number")).alias("m"))
        .select("dataset_id", F.col("m.version_number").alias("baseline_version"))
    )
    explicit = inputs.datasets(spark, root).where("dataset_no = 1").select("dataset_id", F.lit(4).alias("baseline_version"))
    return drift.pick_baselines(v, registered, explicit)


@query(
    "c12_previous_version",
    """SELECT o_custkey, o_orderkey, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), -1) AS previous_order FROM orders""",
)
def previous_version(spark, root):
    o = table(spark, root, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    out = previous_in_groups(o, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], "o_orderkey", "previous_order", -1)
    return out.select("o_custkey", "o_orderkey", "previous_order")


@query(
    "c13_range_join_bins",
    """SELECT v.dataset_id, v.version_number, v.row_key, v.column_name, CAST(coalesce(p.bin - 1, -1) AS INTEGER) AS bin FROM num_long v
       LEFT JOIN psi_bins p ON v.dataset_id = p.dataset_id AND v.column_name = p.column_name AND v.value >= p.low
        AND (v.value < p.high OR (p.is_last AND v.value = p.high))""",
)
def range_join_bins(spark, root):
    """Each number falls in one baseline bin of its dataset and column, or in none (-1)."""
    d = inputs.dirty_orders(spark, root)
    cols = profile.numeric_columns(d, K)
    rows = profile.long_numbers(d.select(*K, F.col("o_orderkey").alias("row_key"), *cols), [*K, "row_key"], cols)
    edges = with_broadcast(drift.bin_edges(rows.where("version_number = 1"), ["dataset_id", "column_name"]))
    return rows.join(edges, ["dataset_id", "column_name"], "left").select(
        *K, "row_key", "column_name", F.coalesce(drift.bin_of(F.col("value"), F.col("edges")), F.lit(-1)).alias("bin")
    )


@query(
    "c14_parent_children",
    """SELECT d.dataset_id, d.version_number, coalesce(r, '') AS rules_broken, coalesce(n, 0) AS findings FROM (SELECT DISTINCT dataset_id, version_number FROM versions_v) d
       LEFT JOIN (SELECT dataset_id, version_number, string_agg(rule_id || ':' || severity, ',' ORDER BY rule_id) AS r, count(*) AS n
                  FROM violations_v WHERE severity <> 'low' GROUP BY ALL) v USING (dataset_id, version_number)""",
)
def parent_children(spark, root):
    """Runs with their findings; a run has at most as many children as there are rules."""
    kids = (
        reports.violation_facts(spark, root)
        .where("severity <> 'low'")
        .groupBy(*K)
        .agg(F.sort_array(F.collect_list(F.struct("rule_id", "severity"))).alias("c"))
    )
    line = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["rule_id"].cast("string"), x["severity"])), ",")
    return inputs.versions(spark, root).select(*K).join(kids, K, "left").select(
        *K, F.coalesce(line, F.lit("")).alias("rules_broken"), F.coalesce(F.size("c"), F.lit(0)).cast("bigint").alias("findings")
    )
