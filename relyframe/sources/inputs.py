"""Dataset versions derived from the given tables.

The tables are clean, so nulls, duplicates, outliers and schema changes are
put in by fixed arithmetic on the keys. Every row of the source is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.sources.tables import table

KEYS = ["dataset_id", "version_number"]
AS_OF = "2024-02-01 00:00:00"
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
LAST_VERSION = 7


def orders_v(spark: SparkSession, root: str) -> DataFrame:
    """``orders`` split into five datasets with one version per year."""
    return table(spark, root, "orders").select(
        F.col("o_orderpriority").alias("dataset_id"),
        (F.year("o_orderdate") - 1994).alias("version_number"),
        *ORDER_COLUMNS,
    )


def dirty_orders(spark: SparkSession, root: str) -> DataFrame:
    o = orders_v(spark, root)
    key, ver, price = F.col("o_orderkey"), F.col("version_number"), F.col("o_totalprice")
    o = o.withColumn(
        "o_totalprice",
        F.when(key % 17 == ver, None).when(key % 101 == 0, price * 20).otherwise(price),
    ).withColumn("o_orderstatus", F.when(key % 23 != 0, F.col("o_orderstatus")))
    # A repeated upload: some rows arrive twice, more of them in later versions.
    copies = F.when(key % 50 < ver, F.lit(2)).otherwise(F.lit(1))
    return o.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


def shifted_orders(spark: SparkSession, root: str) -> DataFrame:
    """Prices rise 5 % per version: a known mean shift for drift checks."""
    o = orders_v(spark, root)
    return o.withColumn("o_totalprice", F.col("o_totalprice") * (1 + F.lit(0.05) * F.col("version_number")))


def raw_orders(spark: SparkSession, root: str) -> DataFrame:
    """Text rows whose schema changes from version to version.

    ``o_custkey`` becomes ``customer_id`` in version 3, the status is coded as
    a digit from version 5, and prices lose their decimals in version 6.
    """
    o = dirty_orders(spark, root)
    v, status = F.col("version_number"), F.col("o_orderstatus")
    status_code = F.when(status == "F", "1").when(status == "O", "2").when(status == "P", "3")
    whole = F.floor("o_totalprice").cast("bigint").cast("string")
    return o.select(
        *KEYS,
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.when(v < 3, F.col("o_custkey").cast("string")).alias("buyer_name"),
        F.when(v >= 3, F.col("o_custkey").cast("string")).alias("customer_id"),
        F.when(v >= 5, status_code).otherwise(F.col("o_orderstatus")).alias("state_code"),
        F.when(v >= 6, whole).otherwise(F.concat(whole, F.lit(".5"))).alias("total_price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_date"),
    )


RAW_COLUMNS = ["order_id", "buyer_name", "customer_id", "state_code", "total_price", "created_date"]


def datasets(spark: SparkSession, root: str) -> DataFrame:
    return (
        table(spark, root, "orders")
        .select(F.col("o_orderpriority").alias("dataset_id"))
        .distinct()
        .select(
            "dataset_id",
            F.substring("dataset_id", 1, 1).cast("int").alias("dataset_no"),
            F.substring_index("dataset_id", "-", -1).alias("dataset_name"),
        )
    )


def versions(spark: SparkSession, root: str) -> DataFrame:
    """One row per dataset version with its upload time."""
    age = (F.lit(LAST_VERSION) - F.col("version_number")) * 24 + 6 * F.substring("dataset_id", 1, 1).cast("int")
    return (
        orders_v(spark, root)
        .groupBy(*KEYS)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .withColumn("created_at", F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(hours=age))
    )


def _event_keys(events: DataFrame) -> DataFrame:
    return events.withColumn("dataset_no", (F.col("user_id") % 5 + 1).cast("int")).withColumn(
        "version_number", (F.dayofmonth("ts") % LAST_VERSION + 1).cast("int")
    )


def incidents(spark: SparkSession, root: str) -> DataFrame:
    """Every error event is an incident; its value sets the severity."""
    e = _event_keys(table(spark, root, "events").where(F.col("event_type") == "error"))
    value = F.col("value")
    return e.select(
        F.col("event_id").alias("incident_id"),
        "dataset_no",
        "version_number",
        F.element_at(
            F.array(F.lit("OPEN"), F.lit("INVESTIGATING"), F.lit("RESOLVED")), (F.col("event_id") % 3 + 1).cast("int")
        ).alias("status"),
        F.when(value > 100, "critical").when(value > 50, "high").when(value > 20, "medium").otherwise("low").alias(
            "severity"
        ),
        F.col("ts").alias("created_at"),
        "value",
        "user_id",
    )


def refreshes(spark: SparkSession, root: str) -> DataFrame:
    """Expected and actual refresh times, one per event."""
    e = _event_keys(table(spark, root, "events"))
    shift = F.col("user_id") % 60 - (F.col("user_id") % 4) * 30
    return e.select(
        F.col("event_id").alias("record_id"),
        "dataset_no",
        (F.date_trunc("hour", "ts").cast("timestamp_ntz") + F.make_dt_interval(mins=shift.cast("int"))).alias(
            "expected_time"
        ),
        F.col("ts").alias("actual_time"),
    )


def edges(spark: SparkSession, root: str) -> DataFrame:
    """Dependencies over customer keys: a binary tree with some two-node loops."""
    c = table(spark, root, "customer").select(F.col("c_custkey").alias("k"))
    tree = c.where("k > 0").select(
        F.floor((F.col("k") - 1) / 2).cast("bigint").alias("src"),
        F.col("k").alias("dst"),
        F.lit("derived_from").alias("relationship"),
    )
    back = c.where("k > 0 AND k % 97 = 0").select(
        F.col("k").alias("src"),
        F.floor((F.col("k") - 1) / 2).cast("bigint").alias("dst"),
        F.lit("feeds_back").alias("relationship"),
    )
    return tree.unionByName(back)
