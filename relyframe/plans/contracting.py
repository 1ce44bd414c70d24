"""Contracts of the derived datasets: two per dataset, the newer one active."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.operators import contracts, quality, schema
from relyframe.session import fact_table
from relyframe.sources import inputs

# What the active contract of every dataset expects.
EXPECTATIONS = [
    (1, "column_exists", "customer_id", None, "critical"),
    (2, "column_type", "total_price", "QUANTITY", "high"),
    (3, "max_null_pct", "state_code", "4.0", "medium"),
    (4, "uniqueness", "order_id", "95.0", "high"),
    (5, "regex", "state_code", "[FOP]", "high"),
    (6, "range", "total_price", '{"min": 1200, "max": 9000000}', "low"),
]
RULES = [(n * 100 + k, n * 10 + 1, kind, col, want, sev) for n in range(1, 6) for k, kind, col, want, sev in EXPECTATIONS]


def contract_table(spark: SparkSession, root: str) -> DataFrame:
    d = inputs.datasets(spark, root).withColumn("s", F.explode(F.array(F.lit(0), F.lit(1))))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return d.select(
        (F.col("dataset_no") * 10 + F.col("s")).alias("contract_id"),
        "dataset_id",
        (start + F.make_dt_interval(days=F.col("s") * 14)).alias("created_at"),
    )


def schema_facts(spark: SparkSession, root: str) -> DataFrame:
    return fact_table(spark, root, "schema", lambda: schema.infer_types(inputs.raw_orders(spark, root), inputs.KEYS))


def contract_violations(spark: SparkSession, root: str) -> DataFrame:
    def build():
        raw = inputs.raw_orders(spark, root)
        rates = quality.uniqueness_rates(raw, inputs.KEYS, ["order_id"])
        types = schema.semantic_catalog(schema_facts(spark, root))
        return contracts.check_contracts(spark, raw, inputs.KEYS, contract_table(spark, root), RULES, types, rates)

    return fact_table(spark, root, "contract_violations", build)
