"""H: scalar functions, each over a whole table."""

from pyspark.sql import functions as F

from relyframe.catalog.registry import query, r4
from relyframe.functions import scores
from relyframe.operators import quality
from relyframe.plans import insight
from relyframe.sources import inputs
from relyframe.sources.tables import table

K = inputs.KEYS


@query("h01_anchored_regex", "SELECT page_id, regexp_matches(url, '^(?:https://[a-z]+[.]example)') AS matched FROM pages")
def anchored_regex(spark, root):
    p = table(spark, root, "pages")
    return p.select("page_id", F.col("url").rlike(quality.anchored("https://[a-z]+[.]example")).alias("matched"))


@query(
    "h02_preset_patterns",
    r"""SELECT c_custkey, regexp_matches(mail, '^(?:^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$)') AS email_ok,
              regexp_matches(phone, '^(?:^\+?[1-9]\d{1,14}$)') AS phone_ok, regexp_matches(zip, '^(?:^\d{5}(-\d{4})?$)') AS zip_ok FROM
       (SELECT c_custkey, lower(c_mktsegment) || CASE WHEN c_custkey % 7 = 0 THEN '#' ELSE '@' END || 'mail.com' AS mail,
               '+' || (c_custkey % 11)::VARCHAR || substr(c_name, 10) AS phone, lpad((c_custkey * 37)::VARCHAR, 5, '0') AS zip FROM customer)""",
)
def preset_patterns(spark, root):
    c = table(spark, root, "customer")
    key = F.col("c_custkey")
    mail = F.concat(F.lower("c_mktsegment"), F.when(key % 7 == 0, "#").otherwise("@"), F.lit("mail.com"))
    phone = F.concat(F.lit("+"), (key % 11).cast("string"), F.substring("c_name", 10, 100))
    number = (key * 37).cast("string")
    zip_code = F.when(F.length(number) >= 5, F.substring(number, 1, 5)).otherwise(F.lpad(number, 5, "0"))
    ok = lambda c, p: c.rlike(quality.anchored(quality.preset(p)))
    return c.select("c_custkey", ok(mail, "EMAIL").alias("email_ok"), ok(phone, "phone").alias("phone_ok"), ok(zip_code, "ZIPCODE").alias("zip_ok"))


@query(
    "h03_rule_strings",
    """SELECT o_orderkey, 'COLUMN_REGEX' AS kind, o_orderstatus AS column_name, o_orderpriority AS pattern, 'k' || o_custkey AS ref_column, 'orders' AS target_table, 'c' || o_orderkey AS target_column FROM orders""",
)
def rule_strings(spark, root):
    """Rule texts built from each row and taken apart again."""
    o = table(spark, root, "orders")
    rx = F.concat(F.lit("COLUMN_REGEX:"), "o_orderstatus", F.lit(":"), "o_orderpriority")
    ref = F.concat(F.lit("REFERENTIAL:k"), "o_custkey", F.lit("->orders:c"), "o_orderkey")
    rule = lambda text: [F.lit(0).alias("rule_id"), F.lit("").alias("rule_name"), text.alias("rule_type"), F.lit(0.0).alias("threshold"), F.lit(True).alias("enabled")]
    first = quality.split_rules(o.select("o_orderkey", ref.alias("ref"), *rule(rx)), ["o_orderkey", "ref"])
    first = first.select("o_orderkey", "ref", F.struct("kind", "column_name", "pattern").alias("first"))
    both = quality.split_rules(first.select("o_orderkey", "first", *rule(F.col("ref"))), ["o_orderkey", "first"])
    return both.select("o_orderkey", "first.*", F.col("column_name").alias("ref_column"), "target_table", "target_column")


@query(
    "h04_case_contains",
    """SELECT p_partkey, upper(p_name) AS upper_name, lower(p_brand) AS lower_brand, contains(lower(p_type), 'eco') AS economy FROM part""",
)
def case_contains(spark, root):
    return table(spark, root, "part").select(
        "p_partkey",
        F.upper("p_name").alias("upper_name"),
        F.lower("p_brand").alias("lower_brand"),
        F.lower("p_type").contains("eco").alias("economy"),
    )


@query(
    "h05_formatted_message",
    """SELECT o_orderkey, printf('Column ''%s'' maximum %.2f exceeds threshold %.4f', o_orderstatus, o_totalprice, o_custkey / 7.0::DOUBLE) AS message FROM orders""",
)
def formatted_message(spark, root):
    o = table(spark, root, "orders")
    return o.select(
        "o_orderkey",
        F.format_string("Column '%s' maximum %.2f exceeds threshold %.4f", "o_orderstatus", "o_totalprice", F.col("o_custkey") / 7.0).alias("message"),
    )


@query(
    "h06_template_fill",
    """SELECT event_id, 'Explain incident ''' || event_type || ''' (severity: ' || user_id || ') with description: ' || props || '.' AS prompt FROM events""",
)
def template_fill(spark, root):
    e = table(spark, root, "events")
    text = insight.fill_template(
        insight.INCIDENT_PROMPT, incident_title=F.col("event_type"), severity=F.col("user_id").cast("string"), description=F.col("props")
    )
    return e.select("event_id", text.alias("prompt"))


@query(
    "h07_split_explode",
    """SELECT p_partkey, trim(t) AS tag FROM (SELECT p_partkey, unnest(string_split(p_name || ', ' || p_brand || ' ,, ' || p_type, ',')) AS t FROM part) WHERE trim(t) <> ''""",
)
def split_explode(spark, root):
    tags = F.concat("p_name", F.lit(", "), "p_brand", F.lit(" ,, "), "p_type")
    p = table(spark, root, "part").select("p_partkey", F.explode(F.split(tags, ",")).alias("t"))
    return p.select("p_partkey", F.trim("t").alias("tag")).where("tag <> ''")


@query("h08_hashes", "SELECT doc_id, sha256(text) AS text_sha256, md5(text) AS text_md5 FROM documents")
def hashes(spark, root):
    return table(spark, root, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.md5("text").alias("text_md5"))


@query(
    "h09_json",
    """SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, '{"type":"' || event_type || '","user":' || user_id || '}' AS built FROM events""",
)
def json_functions(spark, root):
    return table(spark, root, "events").select(
        "event_id",
        F.from_json("props", "k bigint")["k"].alias("k"),
        F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("built"),
    )


@query(
    "h10_lenient_cast",
    """SELECT source, count(*) AS n, count(TRY_CAST(v AS DOUBLE)) AS numeric, round(coalesce(sum(TRY_CAST(v AS DOUBLE)), 0), 4) AS total
       FROM (SELECT event_type AS source, CASE WHEN event_id % 3 = 0 THEN event_type ELSE user_id::VARCHAR END AS v FROM events) GROUP BY 1""",
)
def lenient_cast(spark, root):
    v = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string")).try_cast("double")
    e = table(spark, root, "events").select(F.col("event_type").alias("source"), v.alias("v"))
    return r4(
        e.groupBy("source").agg(
            F.count(F.lit(1)).alias("n"), F.count("v").alias("numeric"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total")
        )
    )


@query(
    "h11_time_difference",
    """SELECT record_id, delay_minutes, CAST(trunc((epoch_us(actual_time) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0) AS INTEGER) AS hours FROM freshness_v""",
)
def time_difference(spark, root):
    r = inputs.refreshes(spark, root)
    return r.select(
        "record_id",
        scores.delay_minutes("actual_time", "expected_time").alias("delay_minutes"),
        F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '2024-01-01 00:00:00', actual_time)").cast("int").alias("hours"),
    )


@query(
    "h12_date_arithmetic",
    """SELECT o_orderkey, CAST(o_orderdate + INTERVAL 90 DAY AS VARCHAR) AS expires_at, CAST(o_orderdate - INTERVAL 24 HOUR AS VARCHAR) AS fresh_since FROM orders""",
)
def date_arithmetic(spark, root):
    o = table(spark, root, "orders")
    return r4(
        o.select(
            "o_orderkey",
            (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(90))).alias("expires_at"),
            (F.col("o_orderdate") - F.make_dt_interval(hours=F.lit(24))).alias("fresh_since"),
        )
    )


@query(
    "h13_numeric_functions",
    """SELECT event_id, round(greatest(0, least(100, value)), 4) AS clamped, round(value, 2) AS rounded, round(abs(50 - value), 4) AS distance, round(ln(value), 4) + 0.0 AS log_value FROM events WHERE value > 0""",
)
def numeric_functions(spark, root):
    e, v = table(spark, root, "events").where("value > 0"), F.col("value")
    return r4(
        e.select("event_id", scores.clamp(v).alias("clamped"), F.round(v, 2).alias("rounded"), F.abs(50 - v).alias("distance"), F.ln(v).alias("log_value"))
    )


@query(
    "h14_banded_label",
    """SELECT event_id, CASE WHEN value >= 90 THEN 'Healthy' WHEN value >= 75 THEN 'Warning' WHEN value >= 50 THEN 'Degraded' ELSE 'Critical' END AS label FROM events""",
)
def banded_label(spark, root):
    return table(spark, root, "events").select("event_id", scores.band(F.col("value"), scores.HEALTH_BANDS, "Critical").alias("label"))


@query(
    "h15_lookup_weight",
    """SELECT incident_id, severity, CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5 ELSE 0.2 END::DOUBLE AS weight FROM incidents_v""",
)
def lookup_weight(spark, root):
    i = inputs.incidents(spark, root)
    return i.select("incident_id", "severity", scores.lookup(F.col("severity"), scores.PRIORITY_WEIGHTS, 0.2).alias("weight"))


@query("h16_token_estimate", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS tokens FROM documents")
def token_estimate(spark, root):
    return table(spark, root, "documents").select("doc_id", insight.word_count(F.col("text")).alias("tokens"))
