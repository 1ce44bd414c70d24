"""P: streaming monitors over several deliveries with late rows; each SQL is the batch twin."""

from pyspark.sql import functions as F

from relyframe.catalog.registry import query, r4
from relyframe.session import scratch
from relyframe.sources.tables import table
from relyframe.streaming import lifecycle
from relyframe.streaming import monitors as m


def _feed(spark, root):
    """Events in four deliveries by time; a tenth of the first delivery's users arrive with the last one."""
    events = table(spark, root, "events")
    lo, hi = events.agg(F.min("ts").cast("timestamp").cast("long"), F.max("ts").cast("timestamp").cast("long")).first()
    share = (F.col("ts").cast("timestamp").cast("long") - F.lit(lo)) * 4 / F.lit((hi - lo or 1) + 1)
    number = F.when((share < 1) & (F.xxhash64("user_id") % 10 == 0), 3).otherwise(F.floor(share).cast("int"))
    path, most = scratch(spark, "feed"), 1
    for i in range(4):
        events.where(number == i).write.parquet(f"{path}/{i}")
        most = max(most, len(spark.read.parquet(f"{path}/{i}").inputFiles()))
    return m.event_stream(spark, f"{path}/*", events.schema, most)


def _when(df):
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "p01_sliding_rate",
    """SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * i), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(count(*) / 3600.0::DOUBLE, 4) AS rate
       FROM events, (SELECT unnest([0, 1, 2, 3]) AS i) GROUP BY 1, 2""",
)
def sliding_rate(spark, root):
    return r4(_when(m.run(_feed(spark, root), m.rates())))


@query(
    "p02_tumbling_histogram",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, count(*) FILTER (WHERE value <= 5) AS le_5,
              count(*) FILTER (WHERE value <= 10) AS le_10, count(*) FILTER (WHERE value <= 25) AS le_25, count(*) FILTER (WHERE value <= 50) AS le_50, count(*) FILTER (WHERE value <= 100) AS le_100,
              count(*) FILTER (WHERE value <= 250) AS le_250 FROM events GROUP BY 1, 2""",
)
def tumbling_histogram(spark, root):
    return r4(_when(m.run(_feed(spark, root), m.histograms())))


RULES = [(1, "error_pct", ">", 30.0), (2, "mean_value", ">=", 60.0), (3, "mean_value", "<", 35.0)]


@query(
    "p03_quality_alerts",
    """SELECT window_start, rule_id, metric, round(value, 4) AS value FROM
       (SELECT w AS window_start, unnest(['error_pct', 'mean_value']) AS metric, unnest([e, v]) AS value FROM
         (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS w, count(*) FILTER (WHERE event_type = 'error') * 100.0::DOUBLE / count(*) AS e, avg(value) AS v FROM events GROUP BY 1))
       JOIN (VALUES (1, 'error_pct', '>', 30.0), (2, 'mean_value', '>=', 60.0), (3, 'mean_value', '<', 35.0)) r(rule_id, metric, op, t) USING (metric)
       WHERE CASE op WHEN '>' THEN value > t WHEN '>=' THEN value >= t ELSE value < t END""",
)
def quality_alerts(spark, root):
    rules = spark.createDataFrame(RULES, "rule_id int, metric string, op string, threshold double")
    return r4(_when(m.run(_feed(spark, root), m.quality_alerts(rules))))


@query("p04_freshness_stream", "SELECT record_id AS event_id, delay_minutes, status FROM freshness_v")
def freshness_stream(spark, root):
    return m.run_append(m.freshness(_feed(spark, root)))


@query(
    "p05_alert_states",
    """SELECT user_id AS alert_id, max_by(CASE WHEN event_type = 'error' THEN 'OPEN' WHEN event_type IN ('view', 'click') THEN 'ACKNOWLEDGED' ELSE 'RESOLVED' END, (ts, event_id)) AS status,
              count(*) AS changes, count(*) FILTER (WHERE event_type = 'error') AS times_opened FROM events GROUP BY 1""",
)
def alert_states(spark, root):
    return lifecycle.run(lifecycle.statuses(_feed(spark, root))).select("alert_id", "status", "changes", "times_opened")
