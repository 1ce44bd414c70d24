"""Data contracts: expectations per dataset, checked against each version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relyframe.operators.profile import value_columns
from relyframe.operators.quality import anchored

RULE_SCHEMA = "rule_id int, contract_id int, rule_type string, column_name string, expected_value string, severity string"

# Message formats of the contract rules.
MESSAGES = {
    "column_exists": "Required column '%s' is missing from the schema.",
    "column_type": "Column '%s' inferred type '%s' does not match expected '%s'.",
    "max_null_pct": "Column '%s' null percentage %.2f%% exceeds threshold of %.2f%%.",
    "uniqueness": "Column '%s' uniqueness ratio %.2f%% is below expected threshold of %.2f%%.",
    "regex": "Column '%s' has %d values that do not match the expected pattern.",
    "range_min": "Column '%s' has values below minimum limit of %.2f.",
    "range_max": "Column '%s' has values above maximum limit of %.2f.",
}


def contract_rules(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RULE_SCHEMA)


def active_contracts(contracts: DataFrame) -> DataFrame:
    """The newest contract of a dataset is active, older ones are deprecated."""
    w = Window.partitionBy("dataset_id").orderBy(F.desc("created_at"), F.desc("contract_id"))
    return contracts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def with_status(contracts: DataFrame) -> DataFrame:
    newest = active_contracts(contracts).select("contract_id", F.lit("active").alias("_s"))
    return contracts.join(newest, "contract_id", "left").select(
        *contracts.columns, F.coalesce("_s", F.lit("deprecated")).alias("status")
    )


def schema_hash(columns: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 of the comma-joined sorted column names of each group."""
    names = F.concat_ws(",", F.sort_array(F.collect_set("column_name")))
    return columns.groupBy(*keys).agg(F.sha2(names, 256).alias("schema_hash"))


def contract_metrics(df: DataFrame, keys: list[str], rules: list[tuple]) -> DataFrame:
    """Nulls, patterns and limits of each group in one pass.

    Equal checks of different contracts are computed once: rows are keyed by
    what is checked, not by the rule that asks for it.
    """
    present = set(value_columns(df, keys))
    none_b, none_s = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    checks = sorted(
        {(r[2], r[3], r[4]) for r in rules if r[3] in present and r[4] and r[2] in ("max_null_pct", "regex", "range")}
    )
    aggs, parts = [F.count(F.lit(1)).alias("_n")], []
    for i, (kind, col, expected) in enumerate(checks):
        v, out = F.col(col), f"x{i}"
        fail, side = none_b, none_s
        if kind == "max_null_pct":
            aggs.append(F.count_if(v.isNull()).alias(out))
            fail = F.col(out)
        elif kind == "regex":
            aggs.append(F.count_if(~v.cast("string").rlike(anchored(expected))).alias(out))
            fail = F.col(out)
        else:
            limits = F.from_json(F.lit(expected), "min double, max double")
            num = v.cast("string").try_cast("double")
            low, high = F.bool_or(num < limits["min"]), F.bool_or(num > limits["max"])
            aggs.append(F.struct(low.alias("low"), high.alias("high")).alias(out))
            hit = lambda c: F.coalesce(F.col(f"{out}.{c}"), F.lit(False))  # noqa: B023, E731
            side = F.when(hit("low"), "min").when(hit("high"), "max")
        names = zip(("rule_type", "column_name", "expected_value"), (kind, col, expected))
        parts.append(
            F.struct(*[F.lit(x).alias(n) for n, x in names], F.col("_n").alias("rows"), fail.alias("fail_count"), side.alias("side"))
        )
    wide = df.groupBy(*keys).agg(*aggs)
    if not parts:
        blank = [none_s.alias(n) for n in ("rule_type", "column_name", "expected_value")]
        return wide.select(*keys, *blank, F.col("_n").alias("rows"), none_b.alias("fail_count"), none_s.alias("side"))
    return wide.select(*keys, F.explode(F.array(*parts)).alias("e")).select(*keys, "e.*")


def check_contracts(
    spark: SparkSession,
    df: DataFrame,
    keys: list[str],
    contracts: DataFrame,
    rules: list[tuple],
    column_types: DataFrame,
    unique_rates: DataFrame | None = None,
) -> DataFrame:
    """Violations of the active contract of each dataset version.

    ``column_types`` holds dataset_id, version_number, column_name and
    semantic_type. ``unique_rates`` holds filled and unique_pct per column.
    """
    active = active_contracts(contracts).select("contract_id", "dataset_id")
    todo = F.broadcast(contract_rules(spark, rules)).join(active, "contract_id")
    groups = df.select(*keys).distinct()
    work = groups.join(todo, "dataset_id")
    types = column_types.select(*keys, "column_name", "semantic_type").withColumn("_has", F.lit(True))
    work = work.join(types, [*keys, "column_name"], "left").join(
        contract_metrics(df, keys, rules), [*keys, "rule_type", "column_name", "expected_value"], "left"
    )
    if unique_rates is not None:
        work = work.join(unique_rates.select(*keys, "column_name", "filled", "unique_pct"), [*keys, "column_name"], "left")
    else:
        work = work.withColumn("filled", F.lit(0)).withColumn("unique_pct", F.lit(None).cast("double"))
    kind, col, want = F.col("rule_type"), F.col("column_name"), F.col("expected_value")
    has = F.coalesce("_has", F.lit(False))
    null_pct = F.col("fail_count") * 100.0 / F.col("rows")
    null_cap = F.coalesce(want.try_cast("double"), F.lit(0.0))
    unique_floor = F.coalesce(want.try_cast("double"), F.lit(100.0))
    limits = F.from_json(want, "min double, max double")
    bound = F.when(F.col("side") == "min", limits["min"]).otherwise(limits["max"])
    broken = {
        "column_exists": ((kind == "column_exists") & ~has, []),
        "column_type": ((kind == "column_type") & has & ~F.col("semantic_type").eqNullSafe(want), ["semantic_type", want]),
        "max_null_pct": ((kind == "max_null_pct") & has & (null_pct > null_cap), [null_pct, null_cap]),
        "uniqueness": (
            (kind == "uniqueness") & has & (F.col("filled") > 0) & (F.col("unique_pct") < unique_floor),
            ["unique_pct", unique_floor],
        ),
        "regex": ((kind == "regex") & has & (F.col("fail_count") > 0), ["fail_count"]),
        "range_min": ((kind == "range") & has & (F.col("side") == "min"), [bound]),
        "range_max": ((kind == "range") & has & (F.col("side") == "max"), [bound]),
    }
    message = F.coalesce(*[F.when(hit, F.format_string(MESSAGES[m], col, *args)) for m, (hit, args) in broken.items()])
    return (
        work.withColumn("message", message)
        .where("message IS NOT NULL")
        .select(*keys, "contract_id", "rule_id", "rule_type", "column_name", "severity", "message")
    )
