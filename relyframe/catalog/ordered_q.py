"""E, F, G: ordered operators, sorting and limits, set operations."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relyframe.catalog.registry import query, r4
from relyframe.operators import relational, schema
from relyframe.operators.quantiles import previous_in_groups, rank_in_groups
from relyframe.plans import insight, reports, trends
from relyframe.sources import inputs
from relyframe.sources.tables import table

K = inputs.KEYS


@query(
    "e01_latest_per_key",
    """SELECT o_custkey, o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM
       (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
)
def latest_per_key(spark, root):
    o = relational.latest_per_key(table(spark, root, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return r4(o.select("o_custkey", "o_orderkey", "o_totalprice"))


@query(
    "e02_earliest_per_key",
    """SELECT o_custkey, o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM
       (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""",
)
def earliest_per_key(spark, root):
    o = relational.latest_per_key(table(spark, root, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")])
    return r4(o.select("o_custkey", "o_orderkey", "o_totalprice"))


@query(
    "e03_rank_by_score",
    """SELECT c_mktsegment, c_custkey, round(c_acctbal, 4) AS c_acctbal, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rank FROM customer""",
)
def rank_by_score(spark, root):
    c = table(spark, root, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return r4(rank_in_groups(c, ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")]))


@query(
    "e03_rank_lineitem",
    """SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 4) AS l_extendedprice,
              CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS BIGINT) AS rank FROM lineitem""",
)
def rank_lineitem(spark, root):
    """Three groups over the largest table: numbered in range partitions."""
    li = table(spark, root, "lineitem").select(
        "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    order = [F.desc("l_extendedprice"), *[F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")]]
    return r4(rank_in_groups(li, ["l_returnflag"], order).drop("l_shipdate"))


@query(
    "e03_null_key_groups",
    """SELECT nullif(o_orderpriority, '2-HIGH') AS dataset_id, o_orderkey, row_number() OVER (PARTITION BY nullif(o_orderpriority, '2-HIGH') ORDER BY o_totalprice DESC, o_orderkey) AS rank,
              coalesce(lag(o_orderkey) OVER (PARTITION BY nullif(o_orderpriority, '2-HIGH') ORDER BY o_totalprice DESC, o_orderkey), -1) AS ahead FROM orders""",
)
def null_key_ranks(spark, root):
    """Ranks and the row ahead, with a group of rows that have no dataset."""
    o = table(spark, root, "orders").select(F.nullif("o_orderpriority", F.lit("2-HIGH")).alias("dataset_id"), "o_orderkey", "o_totalprice")
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    ahead = previous_in_groups(rank_in_groups(o, ["dataset_id"], order), ["dataset_id"], order, "o_orderkey", "ahead", -1)
    return ahead.select("dataset_id", "o_orderkey", "rank", "ahead")


@query(
    "e04_rank_movement",
    """SELECT category, dataset_id, refresh, rank, CAST(coalesce(p, rank) AS BIGINT) AS previous_rank, CASE WHEN rank < p THEN 'up' WHEN rank > p THEN 'down' ELSE 'flat' END AS movement
       FROM (SELECT *, lag(rank) OVER (PARTITION BY category, dataset_id ORDER BY refresh) AS p FROM
         (SELECT m AS category, dataset_id, version_number AS refresh, CAST(row_number() OVER (PARTITION BY m, version_number ORDER BY v DESC, dataset_id) AS BIGINT) AS rank
          FROM (SELECT dataset_id, version_number, unnest(['health_score', 'quality_score', 'anomaly_score', 'drift_score']) AS m,
                       unnest([round(health_score, 6), round(quality_score, 6), round(anomaly_score, 6), round(drift_score, 6)]) AS v FROM reports_v)))""",
)
def rank_movement(spark, root):
    """One board per version: each refresh is compared with the one before."""
    s = trends.score_series(reports.reports(spark, root)).withColumn("value", F.round("value", 6))
    board = rank_in_groups(s, ["metric", "version_number"], [F.desc("value"), F.asc("dataset_id")]).select(
        F.col("metric").alias("category"), "dataset_id", F.col("version_number").alias("refresh"), "rank"
    )
    return insight.rank_movement(board)


@query(
    "e05_improvement",
    "SELECT dataset_id, round(max_by(health_score, version_number) - min_by(health_score, version_number), 4) + 0.0 AS improvement FROM reports_v GROUP BY 1",
)
def improvement(spark, root):
    return r4(trends.improvement(reports.reports(spark, root)))


@query(
    "e06_moving_average",
    """SELECT o_custkey, round(avg(o_totalprice), 4) AS moving_average FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 3 GROUP BY 1""",
)
def moving_average(spark, root):
    return r4(trends.moving_average(table(spark, root, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice"))


@query(
    "e07_linear_forecast",
    """SELECT dataset_id, metric, n, round(CASE WHEN n = 1 THEN sole ELSE greatest(0, least(100, intercept + slope * n)) END, 4) AS forecast FROM
       (SELECT dataset_id, metric, count(*) AS n, regr_slope(v, x) AS slope, regr_intercept(v, x) AS intercept, max(v) AS sole FROM
        (SELECT dataset_id, metric, v, (row_number() OVER (PARTITION BY dataset_id, metric ORDER BY version_number) - 1)::DOUBLE AS x FROM
         (SELECT dataset_id, version_number, unnest(['health_score', 'quality_score', 'anomaly_score', 'drift_score']) AS metric,
                 unnest([health_score, quality_score, anomaly_score, drift_score]) AS v FROM reports_v)) GROUP BY ALL)""",
)
def linear_forecast(spark, root):
    return r4(trends.forecast(trends.score_series(reports.reports(spark, root)), ["dataset_id", "metric"], "version_number", "value"))


@query(
    "e08_ordered_history",
    """SELECT dataset_id, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY created_at) AS BIGINT) AS position, version_number, CAST(created_at AS VARCHAR) AS created_at,
              round(health_score, 4) AS health_score, round(quality_score, 4) AS quality_score, round(anomaly_score, 4) AS anomaly_score, round(drift_score, 4) AS drift_score FROM reports_v""",
)
def ordered_history(spark, root):
    """Rows in order with their position: a history is never folded into one cell."""
    h = rank_in_groups(reports.reports(spark, root), ["dataset_id"], [F.asc("created_at")], "position")
    return r4(h.select("dataset_id", "position", "version_number", "created_at", *trends.SCORES))


@query(
    "e09_latest_status",
    """SELECT dataset_no, max_by(delay_minutes, (actual_time, record_id)) AS latest_delay, max_by(status, (actual_time, record_id)) AS latest_status, round(avg(delay_minutes), 4) AS average_delay FROM freshness_v GROUP BY 1""",
)
def latest_status(spark, root):
    from relyframe.plans.governance import freshness_log

    at = F.struct("actual_time", "record_id")
    return r4(
        freshness_log(inputs.refreshes(spark, root))
        .groupBy("dataset_no")
        .agg(
            F.max_by("delay_minutes", at).alias("latest_delay"),
            F.max_by("status", at).alias("latest_status"),
            F.avg("delay_minutes").alias("average_delay"),
        )
    )


@query("f01_single_key_sort", "SELECT p_partkey, p_name, round(p_retailprice, 4) AS p_retailprice FROM part ORDER BY p_retailprice DESC")
def single_key_sort(spark, root):
    return r4(table(spark, root, "part").select("p_partkey", "p_name", "p_retailprice").orderBy(F.desc("p_retailprice")))


@query("f02_multi_key_sort", "SELECT p_brand, p_size, p_partkey FROM part ORDER BY p_brand, p_size")
def multi_key_sort(spark, root):
    return table(spark, root, "part").select("p_brand", "p_size", "p_partkey").orderBy("p_brand", "p_size")


@query(
    "f03_bottom_k",
    """SELECT d.dataset_name, s.version_number, round(reliability_score, 4) AS reliability_score, classification
       FROM (SELECT * FROM scorecards_v ORDER BY reliability_score, dataset_id, version_number LIMIT 5) s JOIN dataset_dim d USING (dataset_id)""",
)
def bottom_k(spark, root):
    low = reports.scorecards(spark, root).orderBy("reliability_score", *K).limit(5)
    return r4(low.join(inputs.datasets(spark, root), "dataset_id").select("dataset_name", "version_number", "reliability_score", "classification"))


@query(
    "f04_recent_n",
    "SELECT incident_id, severity, CAST(created_at AS VARCHAR) AS created_at FROM incidents_v WHERE status = 'OPEN' ORDER BY incidents_v.created_at DESC, incident_id DESC LIMIT 5",
)
def recent_n(spark, root):
    i = inputs.incidents(spark, root).where("status = 'OPEN'").orderBy(F.desc("created_at"), F.desc("incident_id")).limit(5)
    return r4(i.select("incident_id", "severity", "created_at"))


@query("g01_union_of_keys", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_of_keys(spark, root):
    c = table(spark, root, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return c.union(table(spark, root, "supplier").select("s_nationkey")).distinct()


@query("g02_set_difference", "SELECT o_orderkey AS orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set_difference(spark, root):
    o = table(spark, root, "orders").select(F.col("o_orderkey").alias("orderkey"))
    return o.subtract(table(spark, root, "lineitem").select("l_orderkey"))


@query(
    "g03_intersection",
    "SELECT dataset_id, column_name FROM schema_rows WHERE version_number = 1 INTERSECT SELECT dataset_id, column_name FROM schema_rows WHERE version_number = 7",
)
def intersection(spark, root):
    rows = schema.infer_types(inputs.raw_orders(spark, root), K)
    pick = lambda v: rows.where(F.col("version_number") == v).select("dataset_id", "column_name")
    return pick(1).intersect(pick(7))


@query("g04_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct(spark, root):
    return table(spark, root, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query(
    "g05_union_all_findings",
    """SELECT source, dataset_id, version_number, count(*) AS findings FROM (
         SELECT 'quality' AS source, dataset_id, version_number FROM violations_v UNION ALL
         SELECT 'anomaly', dataset_id, version_number FROM num_long JOIN fences_v USING (dataset_id, version_number, column_name) WHERE value < lower_bound OR value > upper_bound UNION ALL
         SELECT 'drift', dataset_id, version_number FROM drift_v WHERE severity <> 'LOW') GROUP BY ALL""",
)
def union_all_findings(spark, root):
    from relyframe.operators.anomaly import iqr_anomalies

    parts = {
        "quality": reports.violation_facts(spark, root),
        "anomaly": iqr_anomalies(inputs.dirty_orders(spark, root), K, ["o_orderkey"]),
        "drift": reports.drift_facts(spark, root).where("severity <> 'LOW'"),
    }
    rows = [d.select(F.lit(n).alias("source"), *K) for n, d in parts.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("source", *K).agg(F.count(F.lit(1)).alias("findings"))
