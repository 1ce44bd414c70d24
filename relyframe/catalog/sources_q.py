"""A: readers and writers. Each query writes below the shared folder and reads back."""

from pyspark.sql import functions as F

from relyframe.catalog.registry import query, r4
from relyframe.plans import reports
from relyframe.session import scratch
from relyframe.sources import inputs, sinks
from relyframe.sources.tables import NA_TOKENS, load_table, read_csv, table

K = inputs.KEYS


@query(
    "a01_csv_scan",
    """SELECT dataset_id, version_number, count(*) AS row_count, count(o_totalprice) AS priced, count(o_orderstatus) AS with_status,
              round(sum(o_totalprice), 4) AS total FROM dirty_orders GROUP BY ALL""",
)
def csv_scan(spark, root):
    """Missing cells are written as the token NA and come back as NULL."""
    path = scratch(spark, "csv")
    inputs.dirty_orders(spark, root).write.option("header", True).option("nullValue", "NA").csv(path)
    schema = (
        "dataset_id string, version_number int, o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
        "o_totalprice double, o_orderdate timestamp_ntz"
    )
    return r4(
        read_csv(spark, path, schema)
        .groupBy(*K)
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count("o_totalprice").alias("priced"),
            F.count("o_orderstatus").alias("with_status"),
            F.sum("o_totalprice").alias("total"),
        )
    )


@query(
    "a01_csv_inferred",
    """SELECT 'bigint' AS key_type, 'double' AS price_type, 'string' AS text_type, count(*) AS row_count, count(*) FILTER (WHERE o_orderkey % 20 > 18) AS priced,
              round(sum(o_totalprice) FILTER (WHERE o_orderkey % 20 > 18), 4) AS total, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS bad, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS broken_lines FROM orders""",
)
def csv_inferred(spark, root):
    """All tokens for a missing price, a header in another order, quoted line breaks, and keys that do not fit a smaller type."""
    tokens = F.array(*[F.lit(t) for t in NA_TOKENS])
    n = (F.col("o_orderkey") % 20 + 1).cast("int")
    path = scratch(spark, "csv")
    table(spark, root, "orders").select(
        F.when(n > len(NA_TOKENS), F.col("o_totalprice").cast("string")).otherwise(F.get(tokens, n - 1)).alias("price"),
        F.concat(F.lit('say "so",'), F.when(F.col("o_orderkey") % 2 == 0, "\n").otherwise(" "), "o_orderpriority").alias("note"),
        F.when(F.col("o_orderkey") % 3 == 0, "x1").otherwise("7").alias("small"),
        "o_orderkey",
    ).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    found = dict(read_csv(spark, path, multi_line=True).dtypes)
    df = read_csv(spark, path, f"o_orderkey {found['o_orderkey']}, note {found['note']}, price {found['price']}, small int", multi_line=True, bad_cells="bad")
    return r4(df.agg(
        F.lit(found["o_orderkey"]).alias("key_type"), F.lit(found["price"]).alias("price_type"), F.lit(found["note"]).alias("text_type"), F.count(F.lit(1)).alias("row_count"),
        F.count("price").alias("priced"), F.sum("price").alias("total"), F.sum("bad").cast("bigint").alias("bad"), F.count_if(F.col("note").contains("\n")).alias("broken_lines"),
    ))


@query(
    "a02_format_dispatch",
    """SELECT f AS format, count(*) AS row_count, CAST(sum(l_linenumber) AS BIGINT) AS lines, round(sum(l_quantity), 4) AS quantity
       FROM lineitem, (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS f) GROUP BY f""",
)
def format_dispatch(spark, root):
    part = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    schema = "l_orderkey bigint, l_linenumber int, l_quantity double"
    out = None
    for fmt in ("csv", "json", "orc", "parquet"):
        path = f"{scratch(spark, 'fmt')}.{fmt}"
        w = part.write.format(fmt)
        (w.option("header", True) if fmt == "csv" else w).save(path)
        one = load_table(spark, path, None, schema).agg(
            F.count(F.lit(1)).alias("row_count"), F.sum("l_linenumber").alias("lines"), F.sum("l_quantity").alias("quantity")
        ).select(F.lit(fmt).alias("format"), "*")
        out = one if out is None else out.unionByName(one)
    return r4(out)


@query("a03_table_scan", "SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 4) AS s_acctbal FROM supplier")
def table_scan(spark, root):
    return r4(table(spark, root, "supplier"))


@query(
    "a04_append_findings",
    """SELECT dataset_id, version_number, count(*) AS findings, count(DISTINCT rule_id) AS rules FROM violations_v GROUP BY ALL""",
)
def append_findings(spark, root):
    """Two runs append to one fact table: half of the rules each."""
    path = scratch(spark, "findings")
    v = reports.violation_facts(spark, root)
    sinks.append_findings(v.where("rule_id <= 5"), path, K)
    sinks.append_findings(v.where("rule_id > 5"), path, K)
    schema = "rule_id int, severity string, column_name string, actual_value double, expected_value double, message string, dataset_id string, version_number int"
    back = sinks.read_back(spark, path, schema)
    return back.groupBy(*K).agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("rule_id").alias("rules"))


@query(
    "a05_upsert",
    """SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN n ELSE 0 END AS order_count
       FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
       UNION ALL SELECT o_custkey, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""",
)
def upsert(spark, root):
    """Written into a table of 16 parts, of which the upsert rewrites those it touches."""
    part = F.pmod("c_custkey", F.lit(16)).cast("int").alias("part")
    path = scratch(spark, "upsert")
    old = table(spark, root, "customer").select("c_custkey", F.lit(0).cast("bigint").alias("order_count"), part)
    sinks.replace_by_key(old, path, ["part"])
    new = table(spark, root, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("order_count")).withColumn("part", part)
    sinks.upsert_table(new, path, ["c_custkey", "part"], ["part"])
    return sinks.read_back(spark, path, "c_custkey bigint, order_count bigint, part int").select("c_custkey", "order_count")


@query(
    "a06_replace_by_key",
    """SELECT dataset_id, count(*) AS row_count, count(*) FILTER (WHERE o_totalprice IS NULL) AS missing_price
       FROM (SELECT * FROM dirty_orders WHERE dataset_id LIKE '1-%' UNION ALL
             SELECT * FROM orders_v WHERE dataset_id NOT LIKE '1-%') GROUP BY dataset_id""",
)
def replace_by_key(spark, root):
    """Only the partition of the delivered dataset is replaced."""
    path = scratch(spark, "replace")
    sinks.replace_by_key(inputs.orders_v(spark, root), path, ["dataset_id"])
    sinks.replace_by_key(inputs.dirty_orders(spark, root).where("dataset_id LIKE '1-%'"), path, ["dataset_id"])
    schema = "version_number int, o_orderkey bigint, o_totalprice double, dataset_id string"
    return (
        sinks.read_back(spark, path, schema)
        .groupBy("dataset_id")
        .agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("o_totalprice").isNull()).alias("missing_price"))
    )


@query(
    "a07_csv_export",
    """SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice, '{"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}' AS detail
       FROM orders WHERE o_totalprice > 400000""",
)
def csv_export(spark, root):
    path = scratch(spark, "export")
    view = (
        table(spark, root, "orders")
        .where("o_totalprice > 400000")
        .orderBy(F.desc("o_totalprice"))
        .select(
            "o_orderkey",
            "o_totalprice",
            F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("detail"),
        )
    )
    sinks.export_csv(view, path)
    return r4(read_csv(spark, path, "o_orderkey bigint, o_totalprice double, detail string"))


@query(
    "a08_version_registration",
    """SELECT c_mktsegment AS dataset_id, CAST(1 AS INTEGER) AS next_version FROM customer GROUP BY 1
       UNION ALL SELECT dataset_id, CAST(max(version_number) + 1 AS INTEGER) FROM orders_v GROUP BY 1""",
)
def version_registration(spark, root):
    """Customer segments have no version yet, so theirs is 1."""
    fresh = table(spark, root, "customer").select(F.col("c_mktsegment").alias("dataset_id")).distinct()
    known = inputs.datasets(spark, root).select("dataset_id")
    return sinks.next_versions(known.unionByName(fresh), inputs.orders_v(spark, root).select(*K))


@query(
    "a09_log_append",
    """SELECT event_type AS action, count(*) AS entries, count(DISTINCT user_id) AS users, CAST(min(ts) AS VARCHAR) AS first_at FROM events GROUP BY 1""",
)
def log_append(spark, root):
    path = scratch(spark, "log")
    e = table(spark, root, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("action"))
    sinks.append_log(e.where("action IN ('error', 'signup')"), path)
    sinks.append_log(e.where("action NOT IN ('error', 'signup')"), path)
    return r4(
        sinks.read_back(spark, path)
        .groupBy("action")
        .agg(
            F.count(F.lit(1)).alias("entries"),
            F.count_distinct("user_id").alias("users"),
            F.min("ts").alias("first_at"),
        )
    )
